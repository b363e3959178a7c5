"""Reading image files: nested elements, headers and pixels from their bytes.

``walk`` goes through a file once, with a stack of open sequences and items, in any of the uncompressed encodings (implicit or explicit
VR, either byte order, deflated) and with defined or undefined lengths. A file that is cut off or no image file gives the elements
before the fault and a problem, never a failed job.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: VRs whose length has four bytes, VRs of bytes, and VRs of numbers with their codes; fixed values.
LONG_VRS = ("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV")
BYTE_VRS = ("OB", "OD", "OF", "OL", "OV", "OW", "UN")
NUMBER_VRS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "SV": "q", "UV": "Q"}
KNOWN_VRS = ("AE", "AS", "AT", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UI", *LONG_VRS, *NUMBER_VRS)
#: Transfer syntaxes: explicit VR little endian, implicit VR, big endian, deflated; fixed values.
PLAIN, IMPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, SEQUENCE_END = "FFFEE000", "FFFEE00D", "FFFEE0DD"
PIXELS = "7FE00010"
#: Values and characters of a value that a row shows; fixed values.
MOST_VALUES, MOST_TEXT = 12, 512

#: Tags whose VR and keyword are known without a file telling (implicit VR), and the columns of ``read_headers`` that they fill; fixed values.
TAGS = {
    "00020010": ("UI", "TransferSyntaxUID", "transfer_syntax_uid"),
    "00080005": ("CS", "SpecificCharacterSet", None),
    "00080016": ("UI", "SOPClassUID", "sop_class_uid"),
    "00080018": ("UI", "SOPInstanceUID", "sop_uid"),
    "00080020": ("DA", "StudyDate", "study_date"),
    "00080030": ("TM", "StudyTime", None),
    "00080050": ("SH", "AccessionNumber", "accession_number"),
    "00080060": ("CS", "Modality", "modality"),
    "00080061": ("CS", "ModalitiesInStudy", None),
    "00081030": ("LO", "StudyDescription", "study_description"),
    "0008103E": ("LO", "SeriesDescription", "series_description"),
    "00081115": ("SQ", "ReferencedSeriesSequence", None),
    "00081140": ("SQ", "ReferencedImageSequence", None),
    "00081150": ("UI", "ReferencedSOPClassUID", None),
    "00081155": ("UI", "ReferencedSOPInstanceUID", None),
    "00100010": ("PN", "PatientName", "patient_name"),
    "00100020": ("LO", "PatientID", "patient_id"),
    "00180050": ("DS", "SliceThickness", None),
    "00181164": ("DS", "ImagerPixelSpacing", "imager_pixel_spacing"),
    "0020000D": ("UI", "StudyInstanceUID", "study_uid"),
    "0020000E": ("UI", "SeriesInstanceUID", "series_uid"),
    "00200013": ("IS", "InstanceNumber", "instance_number_text"),
    "00200032": ("DS", "ImagePositionPatient", "position"),
    "00200037": ("DS", "ImageOrientationPatient", "orientation"),
    "00201206": ("IS", "NumberOfStudyRelatedSeries", None),
    "00201208": ("IS", "NumberOfStudyRelatedInstances", None),
    "00280002": ("US", "SamplesPerPixel", "samples"),
    "00280004": ("CS", "PhotometricInterpretation", "photometric"),
    "00280006": ("US", "PlanarConfiguration", "planar"),
    "00280008": ("IS", "NumberOfFrames", "number_of_frames"),
    "00280010": ("US", "Rows", "rows_"),
    "00280011": ("US", "Columns", "columns_"),
    "00280030": ("DS", "PixelSpacing", "pixel_spacing"),
    "00280100": ("US", "BitsAllocated", "bits_allocated"),
    "00280101": ("US", "BitsStored", "bits_stored"),
    "00280103": ("US", "PixelRepresentation", "is_signed"),
    "00281050": ("DS", "WindowCenter", "window_center"),
    "00281051": ("DS", "WindowWidth", "window_width"),
    "00281052": ("DS", "RescaleIntercept", "rescale_intercept"),
    "00281053": ("DS", "RescaleSlope", "rescale_slope"),
    PIXELS: ("OW", "PixelData", None),
}


@dataclass
class Element:
    """One element, or an item of a sequence (vr ITEM, no tag): its place in the tree and its bytes."""

    path: tuple[str, ...]
    tag: str
    vr: str
    depth: int
    value: bytes = b""
    big: bool = False
    items: int = 0
    fragments: bool = False


@dataclass
class Open:
    """An open sequence or item: where it ends (None: at its delimiter), and how its content is written."""

    element: Element
    end: int | None
    explicit: bool
    path: tuple[str, ...]
    depth: int
    is_item: bool
    children: list = field(default_factory=list)


def _fragments_end(data: bytes, at: int, order: str) -> tuple[int, int]:
    """End of the fragments of compressed pixels and of their delimiter."""
    while at + 8 <= len(data):
        group, number, size = struct.unpack_from(order + "HHI", data, at)
        if (group, number) == (0xFFFE, 0xE0DD):
            return at, at + 8
        if group != 0xFFFE or size == UNDEFINED:
            break
        at += 8 + size
    raise ValueError("pixel fragments do not end")


def walk(data: bytes, pixels: bool = True) -> Iterator[Element]:
    """Elements of a file, depth first: a sequence, its items, their elements. Raises ValueError at a fault; stops before pixels if told so.

    The number of a sequence's items is known when its last item is through.
    """
    at, big, explicit = (132, False, True) if data[128:132] == b"DICM" else (0, False, None)
    if explicit is None:
        if len(data) < 8:
            raise ValueError("no image file")
        explicit = data[4:6].decode("latin-1") in KNOWN_VRS
    meta, syntax = at == 132, PLAIN if explicit else IMPLICIT
    stack: list[Open] = []
    while True:
        while stack and stack[-1].end is not None and at >= stack[-1].end:
            stack.pop()
        if at >= len(data):
            if stack:
                raise ValueError("a sequence is cut off")
            return
        if at + 8 > len(data):
            raise ValueError("an element is cut off")
        top = stack[-1] if stack else None
        if meta and data[at : at + 2] != b"\x02\x00":  # the file's own syntax begins after group 2
            meta = False
            big, explicit = syntax == BIG, syntax != IMPLICIT
            if syntax == DEFLATED:
                data, at = zlib.decompressobj(-15).decompress(data[at:]), 0
                continue
        order = ">" if big else "<"
        group, number = struct.unpack_from(order + "HH", data, at)
        tag = f"{group:04X}{number:04X}"
        if group == 0xFFFE:
            size = struct.unpack_from(order + "I", data, at + 4)[0]
            at += 8
            if tag == ITEM and top and not top.is_item:
                n = top.element.items
                top.element.items += 1
                own = Element((*top.path, str(n)), "", "ITEM", top.depth + 1, big=big)
                yield own
                stack.append(Open(own, None if size == UNDEFINED else at + size, top.explicit, own.path, top.depth + 2, True))
            elif tag == ITEM_END and top and top.is_item or tag == SEQUENCE_END and top and not top.is_item:
                stack.pop()
            elif tag == SEQUENCE_END and top and len(stack) > 1:
                del stack[-2:]  # the item's own end is missing
            elif tag == ITEM or not top:
                raise ValueError(f"{tag} outside a sequence")
            continue
        if top and not top.is_item:
            raise ValueError("an element between items")
        is_explicit = top.explicit if top else explicit
        vr = data[at + 4 : at + 6].decode("latin-1") if is_explicit else TAGS.get(tag, ("UN",))[0]
        if is_explicit and vr in LONG_VRS:
            size, head = struct.unpack_from(order + "I", data, at + 8)[0] if at + 12 <= len(data) else 0, 12
        elif is_explicit:
            if vr not in KNOWN_VRS:
                raise ValueError(f"{tag} has no VR")
            size, head = struct.unpack_from(order + "H", data, at + 6)[0], 8
        else:
            size, head = struct.unpack_from(order + "I", data, at + 4)[0], 8
        here = ((top.path if top else ()) + (tag,), top.depth if top else 0)
        begin = at + head
        first = data[begin : begin + 4] == (b"\xff\xfe\xe0\x00" if big else b"\xfe\xff\x00\xe0")
        if tag == PIXELS:
            if not pixels:
                return
            if size == UNDEFINED:
                end, at = _fragments_end(data, begin, order)
                yield Element(here[0], tag, vr, here[1], data[begin:end], big, fragments=True)
                continue
        elif vr == "SQ" or size == UNDEFINED or not is_explicit and vr == "UN" and first:
            if size != UNDEFINED and begin + size > len(data):
                raise ValueError(f"{tag} is cut off")
            own = Element(here[0], tag, "SQ", here[1], big=big)
            yield own
            stack.append(Open(own, None if size == UNDEFINED else begin + size, is_explicit and vr != "UN", own.path, here[1], False))
            at = begin
            continue
        if begin + size > len(data):
            raise ValueError(f"{tag} is cut off")
        value = data[begin : begin + size]
        if tag == "00020010":
            syntax = value.rstrip(b"\0 ").decode("latin-1")
        yield Element(here[0], tag, vr, here[1], value, big)
        at = begin + size


def values(e: Element) -> list:
    """Numbers or texts of an element; texts keep no padding."""
    if e.vr in NUMBER_VRS:
        code = NUMBER_VRS[e.vr]
        n = len(e.value) // struct.calcsize(code)
        return list(struct.unpack_from((">" if e.big else "<") + str(n) + code, e.value))
    if e.vr == "AT":
        return [f"{a:04X}{b:04X}" for a, b in struct.iter_unpack((">" if e.big else "<") + "HH", e.value[: len(e.value) // 4 * 4])]
    text = e.value.decode("utf-8", "replace").strip("\0 ")
    return [text] if e.vr in ("LT", "ST", "UT", "UR") else [v.strip(" ") for v in text.split("\\")] if text else []


def shown(parts: list, more: bool = False) -> str:
    """At most 12 values of at most 512 characters as one text."""
    cut = [t if len(t) <= MOST_TEXT else t[:MOST_TEXT] + "..." for t in map(str, parts[:MOST_VALUES])]
    return ", ".join(cut) + (" ..." if more or len(parts) > MOST_VALUES else "")


def row_of(e: Element) -> tuple[str, str, str, str, str, str, int]:
    """tag_path, tag, keyword, name, vr, value, depth of an element."""
    if e.vr == "ITEM":
        n = int(e.path[-1]) + 1
        return "/".join(e.path), "", f"Item{n}", f"Item #{n}", "ITEM", "", e.depth
    keyword = TAGS.get(e.tag, ("", ""))[1]
    if e.vr == "SQ":
        text = f"Sequence with {e.items} item(s)"
    elif e.tag == PIXELS:
        text = "<Pixel Data omitted>"
    else:
        text = f"<{len(e.value)} bytes>" if e.vr in BYTE_VRS else shown(values(e))
    return "/".join(e.path), e.tag, keyword, _spaced(keyword) or f"({e.tag[:4]},{e.tag[4:]})", e.vr, text, e.depth


def _spaced(keyword: str) -> str:
    """A keyword as words: SOPInstanceUID, SOP Instance UID."""
    import re

    return re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", keyword)


ROW = "tag_path string, tag string, keyword string, name string, vr string, value string, depth int, ord int, problem string"


@udtf(returnType=ROW)
class FileElements:
    """Rows of all elements of a file's bytes; a fault gives a last row with the problem."""

    def eval(self, content: bytes):  # noqa: ANN201
        found, problem = [], None
        try:
            for e in walk(bytes(content or b"")):
                if e.tag != PIXELS:
                    found.append(e)
                else:
                    found.append(Element(e.path, e.tag, e.vr, e.depth))
        except (ValueError, struct.error, zlib.error) as fault:
            problem = str(fault)
        for n, e in enumerate(found):
            yield (*row_of(e), n, None)
        if problem:
            yield "", "", "", "", "", "", 0, len(found), problem


@udtf(returnType="tag_path string, tag string, vr string, value string, ord int")
class FileValues:
    """Whole values of a file's elements that are no bytes, several parts between backslashes; what stands before a fault."""

    def eval(self, content: bytes):  # noqa: ANN201
        try:
            for n, e in enumerate(walk(bytes(content or b""), pixels=False)):
                if e.vr not in ("SQ", "ITEM", *BYTE_VRS):
                    yield "/".join(e.path), e.tag, e.vr, "\\".join(map(str, values(e))), n
        except (ValueError, struct.error, zlib.error):
            return


@udtf(returnType=ROW)
class RecordElements:
    """Rows of all elements of a DICOM-JSON object; what is no element gives a row with the problem."""

    def eval(self, record: str):  # noqa: ANN201
        try:
            tree = json.loads(record or "{}")
        except (ValueError, RecursionError) as fault:
            tree = {"": f"no JSON: {type(fault).__name__}"}
        for n, row in enumerate(flatten(tree if isinstance(tree, dict) else {"": "no object"})):
            yield (*row[:-1], n, row[-1])


def flatten(items: dict) -> Iterator[tuple]:
    """Rows of a DICOM-JSON tree, depth first, by a stack: a sequence, its items, their children; the last field is a problem or None."""
    stack = [((), 0, tag, items[tag]) for tag in sorted(items, reverse=True)]
    while stack:
        path, depth, tag, element = stack.pop()
        here = (*path, tag)
        if tag == "ITEM":
            path, number = path[:-1], int(path[-1])
            yield "/".join((*path, str(number))), "", f"Item{number + 1}", f"Item #{number + 1}", "ITEM", "", depth, None if isinstance(element, dict) else "an item that is no object"
            if isinstance(element, dict):
                stack += [((*path, str(number)), depth + 1, t, element[t]) for t in sorted(element, reverse=True)]
            continue
        keyword = TAGS.get(tag, ("", ""))[1]
        names = keyword, _spaced(keyword) or f"({tag[:4]},{tag[4:]})"
        if not isinstance(element, dict):
            yield "/".join(here), tag, *names, "", "", depth, "an element that is no object"
            continue
        vr, parts = str(element.get("vr") or ""), element.get("Value")
        parts = parts if isinstance(parts, list) else [] if parts is None else [parts]
        if vr == "SQ":
            yield "/".join(here), tag, *names, vr, f"Sequence with {len(parts)} item(s)", depth, None
            stack += [((*here, str(n)), depth + 1, "ITEM", item) for n, item in reversed(list(enumerate(parts)))]
            continue
        if tag == PIXELS:
            text = "<Pixel Data omitted>"
        elif isinstance(element.get("InlineBinary"), str):
            raw = element["InlineBinary"]
            text = f"<{len(raw) * 3 // 4 - raw[-2:].count('=')} bytes>"
        else:
            text = shown([(v.get("Alphabetic") or v.get("Ideographic") or v.get("Phonetic") or "") if isinstance(v, dict) else "" if v is None else v for v in parts])
        yield "/".join(here), tag, *names, vr, text, depth, None


def flatten_files(files: DataFrame) -> DataFrame:
    """path and the elements of files (path, content)."""
    return files.select("path", "content").lateralJoin(FileElements(F.col("content").outer())).drop("content")


def element_values(files: DataFrame) -> DataFrame:
    """file and whole values of the elements of files (path, content): what tag operators and ``parse_gsps`` (as state_tags) read."""
    return files.select(F.col("path").alias("file"), "content").lateralJoin(FileValues(F.col("content").outer())).drop("content")


def flatten_tags(records: DataFrame) -> DataFrame:
    """record_no and the elements of JSON records (record_no, record)."""
    return records.select("record_no", "record").lateralJoin(RecordElements(F.col("record").outer())).drop("record")


# Headers and pixels

COLUMNS = {t: c for t, (_, _, c) in TAGS.items() if c}
WHOLE = ("samples", "planar", "number_of_frames", "rows_", "columns_", "bits_allocated", "bits_stored", "is_signed")


def header(data: bytes, pixels: bool = False) -> tuple[dict, Element | None, str | None]:
    """Header fields of a file, its pixels if asked for, and a problem."""
    out: dict = {}
    image = None
    try:
        for e in walk(data, pixels):
            if e.depth:
                continue
            if e.tag == PIXELS:
                image = e
            elif e.tag in COLUMNS:
                name, found = COLUMNS[e.tag], values(e)
                text = "\\".join(map(str, found))
                out[name] = _whole(text) if name in WHOLE else text
    except (ValueError, struct.error, zlib.error) as fault:
        return out, image, str(fault)
    return out, image, None


def _whole(text: str) -> int | None:
    try:
        return int(float(text.split("\\")[0]))
    except ValueError:
        return None


def _number(text: str | None, other: float) -> float:
    try:
        return float((text or "").split("\\")[0])
    except ValueError:
        return other


def read_headers(files: DataFrame) -> DataFrame:
    """25 header fields of files (path, content), and those that pixels need; unreadable files are left out, a problem is told where fields were read before it."""
    names = [*COLUMNS.values()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                fields, _, problem = header(bytes(content or b""))
                if fields.keys() - {"transfer_syntax_uid"}:
                    rows.append({"path": path, "problem": problem} | fields)
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("path", *names, "problem")})

    schema = "path string, " + ", ".join(f"{n} {'bigint' if n in WHOLE else 'string'}" for n in names) + ", problem string"
    return files.select("path", "content").mapInPandas(run, schema)


#: Of YBR_FULL: red, green and blue from luminance and the two colour differences less 128; fixed values.
YBR = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])


def image_of(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Rows, columns, samples and values of the first frame of a file: rescaled gray values (MONOCHROME1 negated) or 8-bit RGB."""
    h, image, problem = header(data, pixels=True)
    if image is None:
        raise ValueError(problem or "no pixels")
    syntax = h.get("transfer_syntax_uid") or PLAIN
    if image.fragments or syntax not in (PLAIN, IMPLICIT, BIG, DEFLATED):
        raise ValueError(f"compressed pixels ({syntax})")
    bits, samples = h.get("bits_allocated") or 16, h.get("samples") or 1
    if bits not in (8, 16, 32) or samples not in (1, 3, 4):
        raise ValueError(f"{samples} samples of {bits} bits")
    rows, columns = h.get("rows_") or 0, h.get("columns_") or 0
    n = rows * columns * samples
    kind = np.dtype(f"{'>' if image.big else '<'}{'i' if h.get('is_signed') else 'u'}{bits // 8}")
    if n <= 0 or len(image.value) < n * kind.itemsize:
        raise ValueError("too few pixels")
    px = np.frombuffer(image.value, dtype=kind, count=n).astype(np.float64)
    photometric = (h.get("photometric") or "").upper()
    if samples == 1:
        px = px * _number(h.get("rescale_slope"), 1) + _number(h.get("rescale_intercept"), 0)
        return rows, columns, 1, -px if photometric == "MONOCHROME1" else px
    px = px.reshape(samples, -1).T if h.get("planar") == 1 else px.reshape(-1, samples)
    px = px[:, :3]
    if photometric.startswith("YBR_FULL") and bits == 8:
        px = np.floor(np.clip((px - [0, 128, 128]) @ YBR.T + 0.5, 0, 255))
    if bits != 8:
        stored = h.get("bits_stored")
        top = 2.0**stored - 1 if stored else px.max()
        px = px * (255 / top) if top > 0 else px
    return rows, columns, 3, np.floor(np.clip(px, 0, 255)).ravel()


def decode_slices(files: DataFrame) -> DataFrame:
    """path, rows_, columns_, samples, pixels of the first frame of each file (colour: three samples a pixel), or the problem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    row = (path, *image_of(bytes(content or b"")), None)
                except (ValueError, struct.error, zlib.error) as fault:
                    row = (path, None, None, None, None, str(fault))
                yield pd.DataFrame([row], columns=["path", "rows_", "columns_", "samples", "pixels", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, rows_ int, columns_ int, samples int, pixels array<double>, problem string")


# Files as a scanner would have written them


def _element(tag: str, vr: str, value: Column) -> Column:
    """One explicit-VR element as bytes: tag as little-endian hex digits, VR, two length bytes, value of even length."""
    even = F.when(F.length(value) % 2 == 1, F.concat(value, F.unhex(F.lit("20")))).otherwise(value)
    n = F.length(even)
    low, high = F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0")
    return F.concat(F.unhex(F.lit(tag)), F.lit(vr).cast("binary"), F.unhex(F.concat(low, high)), even)


def _short(value: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(value % 256), 2, "0"), F.lpad(F.hex(F.floor(value / 256)), 2, "0")))


def header_files(headers: DataFrame) -> DataFrame:
    """Headers (path and fields) as files (path, content): what a scanner would have written, without pixels."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    parts = [F.unhex(F.lit("00" * 128 + "4449434D")), _element("02001000", "UI", F.lit(PLAIN).cast("binary"))]
    parts += [_element(t, v, text(c)) for t, v, c in (("08001800", "UI", "sop_uid"), ("08006000", "CS", "modality"), ("08003E10", "LO", "series_description"), ("20000D00", "UI", "study_uid"), ("20000E00", "UI", "series_uid"), ("20001300", "IS", "instance_number_text"), ("28000400", "CS", "photometric"))]
    parts += [_element(t, "US", _short(F.coalesce(F.col(c), F.lit(0)))) for t, c in (("28001000", "rows_"), ("28001100", "columns_"))]
    return headers.select("path", F.concat(*parts).alias("content"))


def slice_files(slices: DataFrame) -> DataFrame:
    """Square slices (series_id, i, pixels) as files (path, content) of signed 16-bit pixels."""
    word = lambda v: F.pmod(v.cast("int"), F.lit(65536))
    pair = lambda v: F.concat(F.lpad(F.hex(word(v) % 256), 2, "0"), F.lpad(F.hex(F.floor(word(v) / 256)), 2, "0"))
    side = F.sqrt(F.size("pixels")).cast("int")
    raw = F.unhex(F.array_join(F.transform("pixels", pair), ""))
    parts = [F.unhex(F.lit("00" * 128 + "4449434D")), _element("02001000", "UI", F.lit(PLAIN).cast("binary")), _element("28000400", "CS", F.lit("MONOCHROME2").cast("binary")), _element("28001000", "US", _short(side)), _element("28001100", "US", _short(side)),
             _element("28000001", "US", _short(F.lit(16))), _element("28000301", "US", _short(F.lit(1)))]
    size = F.concat(F.unhex(F.lit("E07F10004F570000")), _short(2 * F.size("pixels")), F.unhex(F.lit("0000")), raw)
    return slices.select(F.concat(F.lit("/data/"), "series_id", F.lit("/"), F.col("i").cast("string")).alias("path"), F.concat(*parts, size).alias("content"))
