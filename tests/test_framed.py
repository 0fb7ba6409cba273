"""Byte ranges of framed files against readers of whole files, at every size of range, with records that look like frames."""

import random

import pytest
from pyspark.sql import functions as F

from aeolis.sources import binary, framed

RNG = random.Random(7)


def bytes_of(n: int) -> bytes:
    return bytes(RNG.randrange(256) for _ in range(n))


def f77(records):
    return b"".join(framed.framed("f77")(records))


def grib(parameter: int, body: bytes) -> bytes:
    one = bytes([0, 0, 28, 3, 7, 80, 255, 0, parameter]) + bytes(19)
    n = 8 + len(one) + len(body) + 4
    return b"GRIB" + n.to_bytes(3, "big") + b"\1" + one + body + b"7777"


def grib2(discipline: int, body: bytes) -> bytes:
    n = 16 + 21 + len(body) + 4
    return b"GRIB\0\0" + bytes([discipline, 2]) + n.to_bytes(8, "big") + (21).to_bytes(4, "big") + bytes([1, 0, 98]) + bytes(14) + body + b"7777"


def bufr(category: int, edition: int, body: bytes) -> bytes:
    one = bytes([0, 0, 22, 0, 0, 74, 0, 0, 0, 0, category]) + bytes(11) if edition == 4 else bytes([0, 0, 18, 0, 0, 59, 0, 0, category]) + bytes(9)
    n = 8 + len(one) + len(body) + 4
    return b"BUFR" + n.to_bytes(3, "big") + bytes([edition]) + one + body + b"7777"


SMALL = [bytes_of(RNG.choice([0, 1, 3, 8, 20, 60])) for _ in range(60)] + [b"\0" * 40, b"\0" * 3, bytes_of(300)]
INNER = f77([bytes_of(10) for _ in range(40)])
#: Records within a record, longer than any range below, and records that begin as others end.
NESTED = [bytes_of(5), INNER, bytes_of(9), INNER + b"\0\0\0\1", f77([INNER]), b"\0\0\0\4abcd\0\0\0\4" * 20]
MESSAGES = [grib(k, bytes_of(RNG.randrange(30))) if k % 3 else grib2(k, bytes_of(RNG.randrange(30))) for k in range(25)]
WRAPPED = [grib(1, b""), grib(2, b"".join(MESSAGES[:5])), b"noise GRIB 7777", MESSAGES[7], b"GRIB", grib(9, b"GRIB")]
REPORTS = [bufr(k, 3 + k % 2, bytes_of(RNG.randrange(20))) for k in range(25)] + [b"BUFR\0\0\0\3", bufr(3, 4, bufr(200, 3, b"") * 4), b"??", bufr(8, 4, b"")]


def whole(kind: str, data: bytes, length: int = 5) -> list[bytes]:
    """Records of a plain reader of the whole file."""
    if kind == "f77":
        return [r["record"] for r in binary._f77(data)]
    if kind == "vbs":
        return [r["record"] for r in binary._vbs(data)]
    if kind == "equal":
        return [data[i : i + length] for i in range(0, len(data), length)]
    mark, out, at = {"grib": b"GRIB", "bufr": b"BUFR"}[kind], [], 0
    while (at := data.find(mark, at)) >= 0:
        size = int.from_bytes(data[at + 8 : at + 16], "big") if data[at + 7 : at + 8] == b"\2" and kind == "grib" else int.from_bytes(data[at + 4 : at + 7], "big")
        if data[at + 7 : at + 8] >= (b"\1" if kind == "grib" else b"\2") and data[at : at + size][-4:] == b"7777" and len(data[at : at + size]) == size:
            out.append(data[at : at + size])
            at += size
        else:
            at += 4
    return out


def by_ranges(kind, path, size, length=5):
    """The steps of framed_records without Spark: ranges, their check, and records."""
    options = {"path": str(path), "kind": kind, "length": str(length), "ranges": "true", "rangebytes": str(size)}
    reader = framed.FramedReader(options)
    found = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    plan = framed.checked(found, kind)
    reader = framed.FramedReader({"kind": kind, "length": str(length)})
    return plan, [r for p in plan for b in reader.read(framed.Range(*p)) for r in b.to_pylist()]


CASES = {
    "f77": (f77([r for r in SMALL if r]), f77(SMALL), f77(NESTED), f77([]) + b"\0\0\0", f77([b"x" * 3000, b"y"])),
    "vbs": (b"".join(framed.framed("vbs", 13)(SMALL)), b"".join(framed.framed("vbs", 50)([b"".join(framed.framed("vbs", 9)(SMALL[:20])), b"z"]))),
    "equal": (bytes_of(103), bytes_of(100), b"x"),
    "grib": (b"".join(MESSAGES), b"junk".join(MESSAGES), b"".join(WRAPPED), b"GRIB" * 30),
    "bufr": (b"".join(REPORTS[:25]), b"".join(REPORTS), b"7777".join(REPORTS)),
}


@pytest.mark.parametrize("kind", CASES)
def test_every_size_of_range(tmp_path, kind):
    for k, data in enumerate(CASES[kind]):
        path = tmp_path / f"{k}.dat"
        path.write_bytes(data)
        want = whole(kind, data)
        for size in [*range(1, 40), 64, 97, 128, 500, 10**6]:
            plan, rows = by_ranges(kind, path, size)
            assert [r["record"] for r in rows] == want, (kind, k, size)
            assert [r["rec_no"] for r in rows] == list(range(len(want)))
            at = [r["offset"] for r in rows]
            assert at == sorted(at) and all(r["size"] == len(r["record"]) for r in rows)
        if k == 0 and len(data) > 1000:
            assert len(by_ranges(kind, path, 64)[0]) > 10


def test_control_words(tmp_path):
    """Files of many blocks: records over several blocks, records that end with a block, empty ones."""
    for k, records in enumerate(([bytes_of(n) for n in (4080, 1, 4072, 4064, 0, 0, 12000, 7, 4088, 8, 4096, 3)] + [bytes_of(RNG.randrange(900)) for _ in range(60)], [], [b""], [b"q" * 50_000])):
        path = tmp_path / str(k)
        path.write_bytes(b"".join(framed.framed("cos")(records)))
        assert path.stat().st_size % 4096 == 0
        for size in (1, 1000, 4096, 5000, 8192, 12288, 20_000, 10**6):
            plan, rows = by_ranges("cos", path, size)
            assert [r["record"] for r in rows] == records, (k, size)
            assert [r["rec_no"] for r in rows] == list(range(len(records)))
        if k == 0:
            assert len(by_ranges("cos", path, 4096)[0]) > 5
    # What the reader of one block reads, this one does too.
    small = [bytes_of(n) for n in (5, 16, 0, 33)]
    assert [r["record"] for r in binary._cos(b"".join(framed.framed("cos")(small)))] == small


def test_broken_files_are_told(tmp_path):
    good = f77(SMALL)
    path = tmp_path / "broken"
    for data in (good[:500] + b"\xff" + good[501:], good[:-6], b"\0\0\1\0" + good):
        path.write_bytes(data)
        with pytest.raises(ValueError):
            whole("f77", data)
        for size in (50, 200, 10**6):
            with pytest.raises(framed.Broken):
                by_ranges("f77", path, size)


def test_one_file_by_many_tasks(spark, tmp_path):
    """Through Spark: many tasks, numbers of records, several files of any size, and pushed filters."""
    for k, data in enumerate((b"".join(MESSAGES * 30), b"", b"".join(WRAPPED))):
        (tmp_path / f"m{k}").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"".join(MESSAGES))
    df = framed.framed_records(spark, f"file://{tmp_path}", "grib", range_bytes=700)
    assert df.rdd.getNumPartitions() > 20
    rows = df.collect()
    want = {f"file://{tmp_path}/m0": MESSAGES * 30, f"file://{tmp_path}/m2": whole("grib", b"".join(WRAPPED))}
    for name, records in want.items():
        mine = sorted((r for r in rows if r["path"] == name), key=lambda r: r["rec_no"])
        assert [bytes(r["record"]) for r in mine] == records and [r["rec_no"] for r in mine] == list(range(len(records)))
    assert len(rows) == sum(map(len, want.values()))
    heads = {(r["edition"], r["centre"], r["code"]) for r in rows if r["path"].endswith("m0")}
    assert heads == {(1, 7, k) for k in range(25) if k % 3} | {(2, 98, k) for k in range(0, 25, 3)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition in ("code = 7", "edition = 1 AND code < 10 AND offset >= 3000", f"path = 'file://{tmp_path}/m2'", "code IN (3, 4, 90) AND size > 40", "code = 7 OR code = 8", "rec_no % 2 = 0"):
            pushed = framed.framed_records(spark, f"file://{tmp_path}", "grib", range_bytes=700).filter(condition)
            assert sorted(pushed.collect()) == sorted(df.filter(condition).collect()) and pushed.count() > 0
        reader = framed.PushedReader({"kind": "grib", "length": "0", "plan": "[]"})
        left = list(reader.pushFilters([framed.EqualTo(("code",), 7), framed.EqualTo(("record",), b""), framed.GreaterThan(("offset",), 5)]))
        assert [f.attribute for f in left] == [("record",)] and len(reader.tests) == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


@pytest.mark.parametrize("kind", ["f77", "vbs", "cos"])
def test_written_files(spark, tmp_path, kind):
    rows = [(f"f{k % 3}", k, None if k == 50 else bytes_of(k % 70)) for k in range(400)] + [(None, 1, b"x")]
    df = spark.createDataFrame(rows, "file string, at int, record binary").repartition(4)
    made = framed.write_framed(df, f"file://{tmp_path}/out", kind, "file", "at", most=11).collect()
    assert {r["path"][-2:]: r["records"] for r in made} == {f"f{k}": sum(1 for f, _, r in rows if f == f"f{k}" and r is not None) for k in range(3)}
    found = framed.framed_records(spark, f"file://{tmp_path}/out", kind, range_bytes=1500).select(F.right("path", F.lit(2)).alias("f"), "rec_no", "record").collect()
    for k in range(3):
        mine = [bytes(r["record"]) for r in sorted((r for r in found if r["f"] == f"f{k}"), key=lambda r: r["rec_no"])]
        assert mine == [r for f, _, r in rows if f == f"f{k}" and r is not None]


def test_tasks_have_no_plan(tmp_path):
    """Neither the reader nor the source takes the plan of all ranges to each task."""
    from pyspark import cloudpickle

    plan = '[["a", 10, 0, 10, 0, 0], ["b", 10, 0, 10, 0, 0]]'
    source = framed.FramedSource({"kind": "f77", "length": "0", "plan": plan})
    reader = source.reader(None)
    assert len(reader.partitions()) == 2
    assert b'"a"' not in cloudpickle.dumps(reader) and b'"a"' not in cloudpickle.dumps(source)


def test_messages_are_looked_for_without_copies(tmp_path):
    """Bytes taken out of the window are in proportion to the file, also where the range is long."""
    path = tmp_path / "many"
    path.write_bytes(b"".join(bufr(3, 4, b"x" * 50) for _ in range(3000)))
    taken = 0

    class Counted(framed.Bytes):
        def at(self, start, n):
            nonlocal taken
            out = super().at(start, n)
            taken += len(out)
            return out

    with framed.opened(str(path)) as file:
        data = Counted(file, path.stat().st_size)
        assert sum(1 for _ in framed.Reported().records(data, 0, data.size)) == 3000
    assert taken < 3 * data.size


@pytest.mark.parametrize("kind", ["f77", "vbs", "cos", "grib"])
def test_one_file_is_framed_by_many_tasks(spark, tmp_path, monkeypatch, kind):
    """Parts of a file made apart hold, one behind the other, what one task would write; nothing else is left."""
    monkeypatch.setattr(framed, "PART_ROWS", 40)
    rows = [("a" if k % 5 else "b", k, bytes_of([0, 3, 60, 700, 4072][k % 5] if k % 7 else k % 50)) for k in range(400)]
    df = spark.createDataFrame(rows, "file string, at int, record binary").repartition(3)
    made = framed.write_framed(df, f"file://{tmp_path}/out", kind, "file", "at", most=100)
    assert "rangepartitioning(file" in made._jdf.queryExecution().toString()
    assert {r["path"][-1]: r["records"] for r in made.collect()} == {"a": 320, "b": 80}
    for name in "ab":
        assert (tmp_path / "out" / name).read_bytes() == b"".join(framed.framed(kind, 100)(r for f, _, r in rows if f == name)), name
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")} == {"a", "b"}


@pytest.mark.parametrize("kind, most", [("f77", 0), ("vbs", 0), ("vbs", 13), ("cos", 0)])
def test_batches_are_framed_as_records_are(kind, most):
    import numpy as np
    import pyarrow as pa

    for records in ([b""] * 3, [bytes_of(n) for n in (4080, 1, 4072, 4064, 0, 0, 12000, 7, 4088, 8, 4096, 3)], [bytes_of(4072)] * 9, [bytes_of(RNG.randrange(90)) for _ in range(900)]):
        for cut in (1, 7, 1000):
            parts = [pa.array([b"?", *records[k : k + cut]], pa.large_binary()).slice(1) for k in range(0, len(records), cut)]
            made = [list(framed.framed_batch(kind, x, most)) for x in parts]
            blocks = framed.laid_blocks((np.array(x[1], np.int64), x[2].view(">u8")) for x in made) if kind == "cos" else (y for x in made for y in x)
            assert b"".join(x.tobytes() for x in blocks) == b"".join(framed.framed(kind, most)(records))


@pytest.mark.parametrize("kind, most", [("f77", 0.1), ("cos", 0.1), ("bufr", 3.1)])
def test_records_are_not_looked_up_byte_by_byte(tmp_path, kind, most):
    """How often bytes are asked for, a record, both when ranges are found and when records are read."""
    records = [bytes_of(40) for _ in range(5000)]
    data = b"".join(bufr(3, 4, r) for r in records) if kind == "bufr" else b"".join(framed.framed(kind)(records))
    (tmp_path / "many").write_bytes(data)
    asked = 0

    class Counted(framed.Bytes):
        def at(self, start, n):
            nonlocal asked
            asked += 1
            return super().at(start, n)

    with framed.opened(str(tmp_path / "many")) as file:
        held, reader = Counted(file, len(data)), framed.FramedReader({"kind": kind, "length": "0"})
        assert framed.kind_of({"kind": kind}).scan(held, 0, len(data))[1] == 5000
        found, asked = asked, 0
        rows = [r for b in reader._records(framed.kind_of({"kind": kind}), held, framed.Range("", len(data), 0, len(data), 0)) for r in b.to_pylist()]
    assert [r["rec_no"] for r in rows] == list(range(5000)) and (kind == "bufr" or [r["record"] for r in rows] == records)
    assert max(found, asked) <= most * 5000, (found, asked)
