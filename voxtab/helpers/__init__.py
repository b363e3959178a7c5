"""Small numpy helpers for what columns cannot say: bytes, Fourier transforms, morphology, ordered folds."""
