"""Volume and surface presets: layers as data, adapted to a volume by rules that are data too.

A preset has layers with a window, an opacity and two colours. A family of presets has rules: for each layer, expressions over the volume's
statistics. One statement joins them: the preset's layers, then the rule of (family, layer).
"""

from __future__ import annotations

from voxtab.plans.statement import Dialect, operator, quote, view

LAYERS = ("bone", "blood", "muscle", "softTissue", "lung", "custom")
#: Layers that are off unless a preset says otherwise: window width and centre, opacity, first and last colour; fixed values.
PLAIN = {
    "bone": (500, 400, 1.0, "#ffffff", "#ffffff"),
    "blood": (200, 220, 0.2, "#d31b1b", "#ffd54a"),
    "muscle": (320, 45, 0.55, "#f2c7b8", "#8a3426"),
    "softTissue": (380, 55, 0.32, "#f1d8c8", "#b06b56"),
    "lung": (1500, -550, 0.22, "#9fd8ff", "#e5f6ff"),
    "custom": (400, 40, 0.3, "#7dd3fc", "#f8fafc"),
}
CTA = ("carotid", "coronaryCta", "bodyCta", "neckCta")
BONES = ("bonePlusPlate", "fracture", "lumbar", "hardware", "bones", "cbctBone", "cbctBone2")
LUNGS = ("lung", "lung2", "lung3")
MIPS = ("mip", "mrMip", "mrAngio", "xray")
#: Layers that presets switch on; fixed values.
PRESETS = (
    (("bone",), "bone", 820, 360, 0.96, "#e8dcc8", "#ffffff"),
    (("bone",), "softTissue", 430, 55, 0.075, "#d6a18a", "#f0d8c9"),
    (("aaa",), "bone", 560, 330, 0.58, "#f2f2f2", "#ffffff"),
    (("aaa",), "blood", 150, 160, 0.52, "#9d0b0b", "#ff3b1f"),
    (("aaa",), "muscle", 260, 125, 0.38, "#d7784a", "#ffc090"),
    (("aaa",), "softTissue", 300, 130, 0.44, "#8f2d18", "#e89b64"),
    (("red",), "bone", 442, 115, 1.0, "#c31616", "#ff6666"),
    (("cardiac",), "bone", 170, 176, 0.9, "#fff9f2", "#7f1720"),
    (("cardiac",), "blood", 170, 7, 0.3, "#ffe082", "#ffb300"),
    (("muscle",), "muscle", 280, 40, 0.58, "#f4cfbf", "#8c3d2e"),
    (("muscle",), "softTissue", 360, 50, 0.28, "#f3ddd1", "#9e6a5a"),
    (("mip",), "bone", 900, 350, 0.35, "#9a9a9a", "#ffffff"),
    (("mip",), "blood", 260, 200, 0.85, "#f7f1b6", "#ffffff"),
    (("xray",), "bone", 1200, 460, 0.78, "#5b6470", "#ffffff"),
    (("xray",), "softTissue", 650, 80, 0.1, "#2d333a", "#b8c0cc"),
    (CTA, "blood", 260, 240, 0.72, "#f6c45b", "#fff6d2"),
    (CTA, "bone", 900, 500, 0.42, "#e8e8e8", "#ffffff"),
    (CTA, "softTissue", 420, 80, 0.12, "#4a1c14", "#a86745"),
    (("bonePlusPlate", "fracture", "lumbar", "bones", "cbctBone"), "bone", 980, 470, 0.92, "#d6c4a6", "#ffffff"),
    (("hardware",), "bone", 980, 470, 0.78, "#d6c4a6", "#ffffff"),
    (("cbctBone2",), "bone", 980, 470, 0.98, "#d6c4a6", "#ffffff"),
    (BONES, "softTissue", 460, 70, 0.06, "#b78872", "#efd6c5"),
    (LUNGS, "lung", 1550, -610, 0.32, "#28435a", "#d9f1ff"),
    (("lung", "lung2"), "bone", 1000, 430, 0.28, "#d9d9d9", "#ffffff"),
    (("lung2",), "softTissue", 420, 45, 0.08, "#5d3024", "#d5a58b"),
    (("renalsStomach", "mrDefault"), "muscle", 320, 55, 0.46, "#d7b09e", "#8d4b3b"),
    (("renalsStomach", "mrDefault"), "softTissue", 420, 70, 0.26, "#f0d0bd", "#aa6a55"),
    (("vesselOutline",), "blood", 220, 210, 0.86, "#ffe9a8", "#ffffff"),
    (("mrMip", "mrAngio"), "custom", 1, 0.82, 0.72, "#b9c8ff", "#ffffff"),
    (("mrAngio",), "blood", 1, 0.72, 0.76, "#dce9ff", "#ffffff"),
    (("cbctRealist",), "bone", 850, 360, 0.86, "#d9c2a4", "#fff8ec"),
    (("cbctRealist",), "softTissue", 380, 70, 0.12, "#b18472", "#e5c7b3"),
)


def clamp(value: str, low: float, high: float | str) -> str:
    return f"greatest({low}, least({high}, {value}))"


def most(*values: str | float) -> str:
    return f"greatest({', '.join(map(str, values))})"


def when(presets: tuple[str, ...], yes: str | float, no: str | float) -> str:
    return f"CASE WHEN preset IN ({', '.join(map(quote, presets))}) THEN {yes} ELSE {no} END"


MID = "(p50 + p90) / 2"
SPAN = "greatest(p99_5 - p50, 1)"
SPAN_AAA = "greatest(p99 - p50, 1)"
SOFT_LOW, SOFT_LOW_RED = clamp("p50", 25, 125), clamp("p50", -40, 90)
SOFT_HIGH, SOFT_HIGH_RED = clamp(most("p90", f"{SOFT_LOW} + 70"), 95, 220), clamp(most("p90", f"{SOFT_LOW_RED} + 60"), 70, 190)
RED_WIDTH = clamp(most(f"({SOFT_HIGH_RED} - {SOFT_LOW_RED}) * 2.3", 240), 220, 520)
RED_CENTER = clamp(f"({SOFT_LOW_RED} + {SOFT_HIGH_RED}) / 2", 35, 130)
BRIGHT = lambda floor, bound: f"CASE WHEN p95 >= {bound} THEN greatest(p75, p90, {floor}, (p90 + p95) / 2) ELSE greatest(p75, p90, {floor}) END"
WIDE = lambda factor, share, top, low="p75", high="p99_5", span=SPAN: clamp(most(f"({high} - {low}) * {factor}", f"{span} * {share}", 1), 1, f"greatest(1, {span} * {top})")

#: Rules by family and layer: enabled (null: as the preset has it), width, centre, opacity (null: as it is), colours (null: as they are). Numbers are fixed values.
RULES: dict[str, dict[str, tuple[str | None, str | None, str | None, str | float | None, str | None, str | None]]] = {
    "aaa": {
        "muscle": ("false", None, None, None, None, None),
        "softTissue": ("true", clamp(most(f"({SOFT_HIGH} - {SOFT_LOW}) * 2.35", 220), 220, 420), clamp(f"({SOFT_LOW} + {SOFT_HIGH}) / 2", 60, 150), clamp("0.22 + least(0.08, greatest(0, p90 - p50) / 900)", 0.22, 0.3), "#3b130d", "#a55a32"),
        "blood": ("true", clamp(most("(p95 - p75) * 3", 185), 185, 340), clamp(BRIGHT(120, 260), 120, 285), clamp("0.56 + least(0.09, greatest(0, p95 - p75) / 360)", 0.54, 0.67), "#9d0b0b", "#ff3b1f"),
        "bone": ("true", clamp(most("(p99_5 - p95) * 4", 720), 680, 1220), clamp(most("p99_5", "p99", 420), 380, 760), clamp("0.58 + least(0.16, greatest(0, p99_5 - greatest(p95, 1)) / 2400)", 0.58, 0.74), "#f2f2f2", "#ffffff"),
    },
    "aaa soft": {
        "muscle": ("true", most("(p90 - p10) * 2.2", 280), "(p10 + p75) / 2", 0.34, "#b65a38", "#ffd0a6"),
        "softTissue": ("true", most("(p95 - p10) * 2.2", 360), "(p10 + p95) / 2", 0.39, "#b3492a", "#ffc18a"),
        "blood": ("true", most("(p95 - p75) * 5.5", 160), clamp("(p75 + p95) / 2", 145, 205), 0.55, "#a60008", "#ff2418"),
        "bone": ("true", clamp(most("(p99_5 - p95) * 3", 520), 480, 920), clamp(most("p99", "p99_5", 300), 260, 620), "CASE WHEN dense_foreground_fraction < 0.01 THEN 0.58 ELSE 0.64 END", "#f2f2f2", "#ffffff"),
    },
    "aaa percentile": {
        "muscle": ("false", None, None, None, None, None),
        "softTissue": ("true", WIDE(2.4, 0.38, 1.4, "p50", "p90", SPAN_AAA), MID, 0.26, "#3b130d", "#a55a32"),
        "blood": ("true", WIDE(2.6, 0.28, 1.2, "p75", "p95", SPAN_AAA), "(p75 + p95) / 2", 0.58, "#9d0b0b", "#ff3b1f"),
        "bone": ("true", WIDE(2.8, 0.18, 1.4, "p90", "p99_5", SPAN_AAA), most("p99", "p95"), 0.62, "#f2f2f2", "#ffffff"),
    },
    "vascular": {
        "blood": ("true", clamp(most("(p95 - p75) * 2.8", 180), 160, 420), clamp(BRIGHT(145, 240), 135, when(("coronaryCta", "bodyCta", "neckCta"), 430, 340)), when(("vesselOutline",), 0.82, 0.68), "#f6c45b", "#fff6d2"),
        "softTissue": (when(("vesselOutline",), "false", "true"), clamp(most("(p90 - p50) * 2.4", 240), 220, 520), clamp(MID, 45, 145), when(("cardiac",), 0.16, 0.1), "#4a1c14", "#a86745"),
        "bone": (when(("vesselOutline",), "false", "true"), clamp(most("(p99_5 - p95) * 4", 760), 680, 1400), clamp(most("p99_5", 430), 380, 850), when(("cardiac",), 0.46, 0.34), "#e8e8e8", "#ffffff"),
    },
    "bone": {
        "bone": ("true", clamp(most("(p99_5 - p75) * 1.6", 650), 560, 1800), clamp(when(("hardware", "bonePlusPlate"), most("p95", "p99", 360, "p99_5", 620), most("p95", "p99", 360)), 320, 1050),
                 when(("bones", "cbctBone2"), 0.98, when(("hardware", "xray"), 0.76, when(("fracture",), 0.94, 0.9))), "#d6c4a6", "#ffffff"),
        "softTissue": (when(("xray", "hardware"), "false", "true"), clamp(most("(p90 - p50) * 2.2", 260), 220, 560), clamp(MID, 35, 135), when(("cbctRealist",), 0.12, 0.05), "#b78872", "#efd6c5"),
    },
    "lung": {
        "lung": ("true", clamp(most(1200, "abs(lo - least(p50, -120)) * 1.8"), 1100, 1900), clamp("lo * 0.35 - 520 * 0.65", -760, -420), when(("lung",), 0.26, 0.34), "#28435a", "#d9f1ff"),
        "bone": (when(("lung3",), "false", "true"), "950", clamp(most("p99", 420), 360, 760), 0.22, "#d9d9d9", "#ffffff"),
        "softTissue": (when(("lung2",), "true", "false"), "420", clamp(MID, 35, 120), 0.08, "#5d3024", "#d5a58b"),
    },
    "mip": {
        "bone": ("true", clamp(most("(p99_5 - p75) * 1.7", 480), 360, 1500), clamp(most("p95", "p99", 220), 160, 820), 0.42, "#9a9a9a", "#ffffff"),
        "blood": ("true", most("(p95 - p75) * 2.4", 220), clamp(most("p90", 160), 120, 420), 0.82, "#f7f1b6", "#ffffff"),
    },
    "soft": {
        "muscle": (when(("red",), "NULL", "true"), when(("red",), "NULL", RED_WIDTH), when(("red",), "NULL", RED_CENTER), when(("red",), "NULL", 0.54), None, None),
        "softTissue": ("true", f"{RED_WIDTH} * 1.18", RED_CENTER, when(("red",), 0.2, 0.24), None, None),
        "bone": (when(("red",), "true", "NULL"), when(("red",), most(320, "(p95 - p50) * 2"), "NULL"), when(("red",), clamp(most("p90", 115), 95, 260), "NULL"), when(("red",), 0.86, "NULL"), None, None),
    },
    "percentile": {
        **{k: (None, WIDE(1.6, 0.25, 1.8), most("p95", "p99"), when(MIPS, "greatest(0.42, opacity)", "NULL"), None, None) for k in ("bone", "blood")},
        "custom": (None, when(MIPS, WIDE(1.6, 0.25, 1.8), WIDE(2.4, 0.35, 1.5, "p50", "p90")), when(MIPS, most("p95", "p99"), MID), when(MIPS, "greatest(0.42, opacity)", "NULL"), None, None),
        **{k: (None, WIDE(2.4, 0.35, 1.5, "p50", "p90"), MID, None, None, None) for k in ("muscle", "softTissue", "lung")},
    },
}
#: Families of presets of a volume in HU; others are adapted by percentiles.
FAMILIES = {
    "vascular": (*CTA, "cardiac", "vesselOutline"),
    "lung": LUNGS,
    "bone": ("bone", "xray", "cbctRealist", *BONES),
    "mip": ("mip",),
    "soft": ("red", "muscle", "renalsStomach"),
}
NAMES = tuple(dict.fromkeys(p for presets, *_ in PRESETS for p in presets))


@view
def preset_layers(d: Dialect) -> str:
    """Every layer of every preset as it is before it is adapted."""
    on = {(p, layer): rest for presets, layer, *rest in PRESETS for p in presets}
    rows = [(p, n, layer, (p, layer) in on, *on.get((p, layer), PLAIN[layer])) for p in NAMES for n, layer in enumerate(LAYERS)]
    values = ", ".join(f"({quote(p)}, {n}, {quote(layer)}, {quote(e)}, cast({w} AS double), cast({c} AS double), cast({o} AS double), {quote(a)}, {quote(z)})" for p, n, layer, e, w, c, o, a, z in rows)
    return f"SELECT preset, cast(n AS int) AS layer_no, layer, enabled, ww, wl, opacity, color_start, color_end FROM (VALUES {values}) v(preset, n, layer, enabled, ww, wl, opacity, color_start, color_end)"


def adapted(field: int, column: str) -> str:
    """Rule of a field by family and layer, the preset's own value without one."""
    cases = []
    for family, layers in RULES.items():
        for layer, rule in layers.items():
            if rule[field] is not None:
                value = quote(rule[field]) if field > 3 else f"round({rule[field]}, 3)" if field in (1, 2, 3) else rule[field]
                cases.append(f"WHEN {quote(f'{family}/{layer}')} THEN {value}")
    change = f"CASE rule {' '.join(cases)} END"
    if column == "color_start" or column == "color_end":
        red, outline = ("#b30f0f", "#ff5b5b"), ("#ffe9a8", "#ffffff")
        n = field - 4
        change = f"CASE WHEN rule = 'soft/bone' AND preset = 'red' THEN {quote(red[n])} WHEN rule = 'vascular/blood' AND preset = 'vesselOutline' THEN {quote(outline[n])} ELSE {change} END"
    changed = f"coalesce({change}, {column})"
    # percentiles adapt only what the preset has switched on
    return f"CASE WHEN family = 'percentile' AND NOT enabled THEN {column} ELSE {changed} END AS {column}"


@operator
def adaptive_layers(d: Dialect) -> str:
    """Layers of each series' preset, windows and opacities adapted to its statistics by the rules of the preset's family."""
    families = " ".join(f"WHEN preset IN ({', '.join(map(quote, presets))}) THEN {quote(f)}" for f, presets in FAMILIES.items())
    soft = "p50 BETWEEN 40 AND 150 AND p95 BETWEEN 90 AND 240 AND p95 - p50 <= 100 AND dense_foreground_fraction < 0.02 AND very_dense_foreground_fraction < 0.005"
    fields = ", ".join(adapted(n, c) for n, c in enumerate(("enabled", "ww", "wl", "opacity", "color_start", "color_end")))
    return f"""SELECT series_id, preset, layer_no, layer, {fields} FROM (SELECT *, family || '/' || layer AS rule FROM (
  SELECT s.*, l.layer_no, l.layer, l.enabled, l.ww, l.wl, l.opacity, l.color_start, l.color_end FROM (
    SELECT i.*, p.preset, CASE WHEN p.preset = 'aaa' THEN CASE WHEN NOT is_ct_hu THEN 'aaa percentile' WHEN {soft} THEN 'aaa soft' ELSE 'aaa' END WHEN NOT is_ct_hu THEN 'percentile' {families} ELSE 'percentile' END AS family
    FROM intensity_stats i JOIN select_preset p ON p.series_id = i.series_id) s JOIN preset_layers l ON l.preset = s.preset) a) b"""


#: Iso values of surfaces without statistics; fixed values.
SURFACES = {"bone": 240, "softTissue": 85, "highDensity": 420}


@operator
def surface_iso_value(d: Dialect, surface: str | None = None) -> str:
    """Value of each surface preset (or of one) of each series: anchors in HU for CT, places between percentiles for others, the preset's own without foreground."""
    rules = {
        "softTissue": (f"CASE WHEN p10 <= -120 THEN {clamp('(p10 + p25) / 2', -350, -80)} ELSE {clamp('(p10 + p50) / 2', -80, 160)} END", "p50"),
        "highDensity": (clamp(most("CASE WHEN very_dense_foreground_fraction >= 0.001 THEN 700 ELSE 450 END", "p95", "p99", "p99_5 * 0.78"), 350, 1800), "p90 + greatest(p99 - p10, 1) * 0.08"),
        "bone": (clamp(most(220, "least(520, greatest(p90, p75 + 90))"), 160, 650), "p75 + greatest(p99 - p10, 1) * 0.05"),
    }
    names = [surface if surface in SURFACES else "bone"] if surface else [*SURFACES]
    each = d.array(*(d.struct(surface=quote(n), iso=f"cast(CASE WHEN foreground_count <= 0 THEN {SURFACES[n]} WHEN is_ct_hu AND (lo <= -500 OR hi >= 300) AND modality NOT IN ('MR', 'CBCT') THEN {rules[n][0]} ELSE greatest(lo, least(hi, {rules[n][1]})) END AS double)") for n in names))
    return f"""SELECT series_id, (x).surface AS surface, round((x).iso, 3) AS iso FROM (SELECT series_id, {d.rows(each)} AS x FROM (
  SELECT s.*, upper(trim(coalesce(m.modality, ''))) AS modality FROM intensity_stats s JOIN image_series m ON m.series_id = s.series_id) q) w"""
