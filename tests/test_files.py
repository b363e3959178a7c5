"""The byte reader on hand-made files: nesting, undefined lengths, byte orders, faults, colour and compressed pixels."""

import json
import struct
import zlib

import numpy as np
import pytest

from voxtab.sources import dicom

PREAMBLE = b"\0" * 128 + b"DICM"


class Writer:
    """Elements in one encoding."""

    def __init__(self, explicit=True, big=False):
        self.explicit, self.order = explicit, ">" if big else "<"

    def tag(self, tag):
        return struct.pack(self.order + "HH", int(tag[:4], 16), int(tag[4:], 16))

    def one(self, tag, vr, value, undefined=False):
        value = value.encode() if isinstance(value, str) else value
        value += b" " * (len(value) % 2)
        size = dicom.UNDEFINED if undefined else len(value)
        if not self.explicit:
            return self.tag(tag) + struct.pack(self.order + "I", size) + value
        if vr in dicom.LONG_VRS:
            return self.tag(tag) + vr.encode() + b"\0\0" + struct.pack(self.order + "I", size) + value
        return self.tag(tag) + vr.encode() + struct.pack(self.order + "H", size) + value

    def number(self, tag, *n):
        return self.one(tag, "US", struct.pack(self.order + f"{len(n)}H", *n))

    def item(self, body, undefined=False):
        size = dicom.UNDEFINED if undefined else len(body)
        return self.tag("FFFEE000") + struct.pack(self.order + "I", size) + body + (self.tag("FFFEE00D") + b"\0" * 4 if undefined else b"")

    def sequence(self, tag, items, undefined=False):
        return self.one(tag, "SQ", b"".join(items), undefined) + (self.tag("FFFEE0DD") + b"\0" * 4 if undefined else b"")


def file(syntax, body):
    meta = Writer()
    return PREAMBLE + meta.one("00020010", "UI", syntax) + (zlib.compress(body)[2:-4] if syntax == dicom.DEFLATED else body)


def nested(w, undefined):
    inner = w.sequence("00081140", [w.item(w.one("00081155", "UI", "1.2.3"), undefined), w.item(b"", undefined)], undefined)
    series = w.sequence("00081115", [w.item(w.one("0020000E", "UI", "9.9") + inner, undefined)], undefined)
    return w.one("00080060", "CS", "PR") + series + w.one("00100010", "PN", "A^B") + w.number("00280010", 7)


WANT = [
    ("00080060", "PR", 0), ("00081115", "Sequence with 1 item(s)", 0), ("00081115/0", "", 1), ("00081115/0/0020000E", "9.9", 2), ("00081115/0/00081140", "Sequence with 2 item(s)", 2),
    ("00081115/0/00081140/0", "", 3), ("00081115/0/00081140/0/00081155", "1.2.3", 4), ("00081115/0/00081140/1", "", 3), ("00100010", "A^B", 0), ("00280010", "7", 0),
]


@pytest.mark.parametrize("undefined", [True, False])
@pytest.mark.parametrize("syntax", [dicom.PLAIN, dicom.IMPLICIT, dicom.BIG, dicom.DEFLATED])
def test_nested_elements(syntax, undefined):
    w = Writer(syntax != dicom.IMPLICIT, syntax == dicom.BIG)
    found = [dicom.row_of(e) for e in list(dicom.walk(file(syntax, nested(w, undefined))))]
    assert [(r[0], r[5], r[6]) for r in found if r[1] != "00020010"] == WANT


def test_without_preamble_and_unknown_sequences():
    w = Writer(False)
    body = w.one("00080060", "CS", "CT") + w.sequence("00099999", [w.item(w.one("00100020", "LO", "x"))])
    assert [dicom.row_of(e)[0] for e in dicom.walk(body)] == ["00080060", "00099999", "00099999/0", "00099999/0/00100020"]
    un = Writer()
    mixed = un.one("00091010", "UN", Writer(False).item(Writer(False).one("00100020", "LO", "y"), True) + un.tag("FFFEE0DD") + b"\0" * 4, True) + un.one("00100020", "LO", "z")
    assert [dicom.row_of(e)[5] for e in list(dicom.walk(PREAMBLE + mixed))] == ["Sequence with 1 item(s)", "", "y", "z"]


@pytest.mark.parametrize("cut", range(0, 190, 3))
def test_faults_never_fail(cut):
    data = file(dicom.PLAIN, nested(Writer(), True))
    got = list(dicom.FileElements.func().eval(data[: 132 + cut])) if hasattr(dicom.FileElements, "func") else []
    assert all(len(r) == 9 for r in got)
    dicom.header(data[: 132 + cut])
    for noise in (b"", b"x", bytes(range(256)) * 3, data[:140] + b"\xff" * 50):
        dicom.header(noise, True)


def picture(w, raw, rows=2, columns=3, bits=16, **more):
    body = b"".join(w.number(t, more.get(n, v)) for t, n, v in (("00280002", "samples", 1), ("00280006", "planar", 0)))
    body += w.one("00280004", "CS", more.get("photometric", "MONOCHROME2")) + w.number("00280010", rows) + w.number("00280011", columns) + w.number("00280100", bits) + w.number("00280101", more.get("stored", bits)) + w.number("00280103", more.get("signed", 0))
    if "slope" in more:
        body += w.one("00281052", "DS", "-10") + w.one("00281053", "DS", more["slope"])
    return body + w.one("7FE00010", "OW", raw)


def test_pixels(spark):
    w, b = Writer(), Writer(big=True)
    v = np.array([1, 2, 3, 300, 400, 65535])
    files = {
        "plain": file(dicom.PLAIN, picture(w, v.astype("<u2").tobytes(), slope="2")),
        "signed inverse, two frames": file(dicom.PLAIN, picture(w, v.astype("<u2").tobytes() * 2, signed=1, photometric="MONOCHROME1")),
        "big": file(dicom.BIG, picture(b, v.astype(">u2").tobytes())),
        "long": file(dicom.PLAIN, picture(w, (v * 1000).astype("<u4").tobytes(), bits=32)),
        "rgb": file(dicom.PLAIN, picture(w, bytes(range(18)), bits=8, samples=3, photometric="RGB")),
        "planes": file(dicom.PLAIN, picture(w, bytes(range(18)), bits=8, samples=3, planar=1, photometric="RGB")),
        "rgb16": file(dicom.PLAIN, picture(w, np.arange(18).astype("<u2").tobytes(), bits=16, samples=3, stored=4, photometric="RGB")),
        "ybr": file(dicom.PLAIN, picture(w, bytes([100, 128, 128] * 5 + [76, 85, 255]), bits=8, samples=3, photometric="YBR_FULL")),
        "bad slope": file(dicom.PLAIN, picture(w, v.astype("<u2").tobytes(), slope="abc")),
        "jpeg": file("1.2.840.10008.1.2.4.50", picture(w, b"")[:-12] + w.one("7FE00010", "OB", w.item(b"\xff\xd8" * 40) + w.tag("FFFEE0DD") + b"\0" * 4, True)),
        "jpeg as if plain": file("1.2.840.10008.1.2.4.50", picture(w, v.astype("<u2").tobytes())),
        "24 bits": file(dicom.PLAIN, picture(w, b"\0" * 18, bits=24)),
        "12 bits": file(dicom.PLAIN, picture(w, b"\0" * 18, bits=12)),
        "short": file(dicom.PLAIN, picture(w, b"\0" * 6)),
        "none": file(dicom.PLAIN, w.one("00080060", "CS", "SR")),
        "text": b"hello",
        "nothing": b"",
    }
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in files.items()] + [("null", None)], "path string, content binary")
    got = {r["path"]: r for r in dicom.decode_slices(df).collect()}
    want = {"plain": (v * 2 - 10).tolist(), "signed inverse, two frames": [-1, -2, -3, -300, -400, 1], "big": v.tolist(), "long": (v * 1000).tolist(), "rgb": list(range(18)), "planes": [x + 6 * c for x in range(6) for c in range(3)],
            "rgb16": [min(255, int(n * 255 / 15)) for n in range(18)], "ybr": [100] * 15 + [254, 0, 0], "bad slope": (v - 10).tolist()}
    for name, pixels in want.items():
        assert got[name]["problem"] is None and got[name]["pixels"] == pytest.approx(pixels), name
    assert got["rgb"]["samples"] == 3 and got["plain"]["samples"] == 1
    assert {n for n, r in got.items() if r["problem"]} == set(files) - set(want) | {"null"}
    heads = {r["path"]: r for r in dicom.read_headers(df).collect()}
    assert heads["plain"]["rescale_slope"] == "2" and heads["rgb"]["samples"] == 3 and heads["none"]["modality"] == "SR" and not {"text", "nothing", "null"} & heads.keys()


def test_udtfs(spark):
    w = Writer()
    good = file(dicom.PLAIN, nested(w, True) + w.one("00209999", "DS", "\\".join(map(str, range(14)))) + w.one("00099998", "OB", b"abcd") + w.one("7FE00010", "OW", b"\0" * 64))
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-70])), ("c", None)], "path string, content binary")
    rows = dicom.flatten_files(df).orderBy("path", "ord").collect()
    a = [r for r in rows if r["path"] == "a" and r["tag"] != "00020010"]
    assert [(r["tag_path"], r["value"], r["depth"]) for r in a] == [*WANT, ("00209999", "0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 ...", 0), ("00099998", "<4 bytes>", 0), ("7FE00010", "<Pixel Data omitted>", 0)]
    assert a[1]["keyword"] == "ReferencedSeriesSequence" and a[2]["vr"] == "ITEM" and a[2]["name"] == "Item #1" and a[6]["name"] == "Referenced SOP Instance UID"
    assert [r["problem"] is not None for r in rows if r["path"] == "b"][-1] and [r["problem"] for r in rows if r["path"] == "c"] == ["no image file"]
    tree = {"00080060": ["x"], "00081140": {"vr": "SQ", "Value": [{"00081155": {"vr": "UI", "Value": ["1"]}}, 5]}, "00100010": {"vr": "PN", "Value": [{"Ideographic": "I"}, None]}, "7FE00010": {"vr": "OW", "InlineBinary": "AAAA"}, "00091001": {"vr": "OB", "InlineBinary": "AAA="}}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "{no"), (3, None), (4, "[1]")], "record_no bigint, record string")
    rows = dicom.flatten_tags(df).orderBy("record_no", "ord").collect()
    assert [(r["tag_path"], r["value"], r["depth"], r["problem"] is not None) for r in rows if r["record_no"] == 1] == [
        ("00080060", "", 0, True), ("00081140", "Sequence with 2 item(s)", 0, False), ("00081140/0", "", 1, False), ("00081140/0/00081155", "1", 2, False), ("00081140/1", "", 1, True),
        ("00091001", "<2 bytes>", 0, False), ("00100010", "I, ", 0, False), ("7FE00010", "<Pixel Data omitted>", 0, False)]
    assert [r["record_no"] for r in rows if r["record_no"] > 1] == [2, 4]


def test_presentation_states_from_files(spark):
    """Bytes of a state with two annotations to measurements: points, tools, texts by place, references, left-over texts."""
    from voxtab.operators import roi

    w = Writer()
    floats = lambda *v: struct.pack(f"<{len(v)}f", *v)

    def graphic(kind, *data, units="PIXEL"):
        return w.item(w.one("00700005", "CS", units) + w.one("00700022", "FL", floats(*data)) + w.one("00700023", "CS", kind), True)

    def text(value, *anchor, units="PIXEL"):
        return w.item(w.one("00700004", "CS", units) + w.one("00700006", "ST", value) + (w.one("00700014", "FL", floats(*anchor)) if anchor else b""))

    shapes = [graphic("POLYLINE", 1, 1, 256, 512), graphic("POLYLINE", 1, 1, 2, 2, units="DISPLAY"), graphic("POLYLINE", 2, 3, 6, 3, 6, 9, 2, 9, 2, 3), graphic("ELLIPSE", 5, 0.5, 9, 4, 7, 2, 7, 6), graphic("POLYLINE", 1, 1, 5, 1, 3, 4), graphic("POINT", 4, 4), graphic("INTERPOLATED", 1, 1, 2, 2)]
    first = w.one("00700002", "CS", "MEASURE") + w.sequence("00700008", [text("210.2 mm"), text(" "), text("box")], True) + w.sequence("00700009", shapes, True)
    second = w.sequence("00081140", [w.item(w.one("00081155", "UI", "")), w.item(w.one("00081155", "UI", "5.5"))]) + w.one("00700002", "CS", "annot") + w.sequence("00700008", [text("here"), text("left", 3, 4), text("nowhere", 3, 4, units="DISPLAY")]) + w.sequence("00700009", [graphic("POLYLINE", 2, 2, 3, 3, 8, 9)])
    refs = w.sequence("00081115", [w.item(b""), w.item(w.sequence("00081140", [w.item(w.one("00081155", "UI", "1.1")), w.item(w.one("00081155", "UI", "1.2"))]))])
    state = file(dicom.PLAIN, w.one("00080018", "UI", "7.7") + refs + w.sequence("00700001", [w.item(first), w.item(second, True)], True))
    bare = file(dicom.PLAIN, w.one("00080018", "UI", "8.8") + w.sequence("00700001", [w.item(first)]))
    df = spark.createDataFrame([("s", bytearray(state)), ("bare", bytearray(bare)), ("bad", bytearray(b"x"))], "path string, content binary")
    got = {r["overlay_id"]: (r["file"], r["ref_uid"], r["kind"], r["tool_type"], [tuple(p) for p in zip(r["xs"], r["ys"])], r["label"]) for r in roi.parse_gsps(state_tags=dicom.element_values(df)).collect()}
    assert got == {
        "gsps-measure-7.7:0:0": ("s", "1.1", "measurement", "line", [(0, 0), (255, 511)], "210.2 mm"),
        "gsps-measure-7.7:0:1": ("s", "1.1", "measurement", "rect", [(1, 2), (5, 8)], "box"),
        "gsps-measure-7.7:0:2": ("s", "1.1", "measurement", "ellipse", [(4, 0), (8, 5)], ""),
        "gsps-measure-7.7:0:3": ("s", "1.1", "measurement", "freeform", [(0, 0), (4, 0), (2, 3)], ""),
        "gsps-annotation-7.7:1:0": ("s", "5.5", "annotation", "arrow", [(1, 1), (7, 8)], "here"),
        "gsps-text-7.7:1:1": ("s", "5.5", "annotation", "arrow", [(2, 3), (3, 4)], "left"),
    }
    assert {(r["file"], r["annotation"], r["ref_uid"]) for r in roi.gsps_references(state_tags=dicom.element_values(df)).collect()} == {("s", 0, "1.1"), ("s", 1, "5.5"), ("bare", 0, None)}
