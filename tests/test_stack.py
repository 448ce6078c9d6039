"""TIFF stacks written byte by byte here, read by the scan; and the way through the sink."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.sources import stack as S

rng = np.random.default_rng(5)
MOVIE = rng.integers(80, 4000, (12, 33, 20)).astype(np.uint16)


def packed_bits(data: bytes) -> bytes:
    out, i = b"", 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out, i = out + bytes((257 - run, data[i])), i + run
        else:
            out, i = out + bytes((min(100, len(data) - i) - 1,)) + data[i : i + 100], i + 100
    return out + b"\x80"


def lzw(data: bytes) -> bytes:
    codes, table, word, width = [(256, 9)], {bytes((i,)): i for i in range(256)}, b"", 9
    count = 258
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = count
        count += 1
        if count == 4094:
            codes.append((256, width))
            table, count, width = {bytes((i,)): i for i in range(256)}, 258, 9
        else:
            width = max(width, (count).bit_length() if count < 512 or count & (count - 1) else count.bit_length())
        word = bytes((b,))
    if word:
        codes.append((table[word], width))
        count += 1
        width = max(width, min(12, count.bit_length()))
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packed_bits}


def tiff(movie, order="<", big=False, compression=1, rows=None, tile=None, predictor=1, description=b"") -> bytes:
    """A file with the directories at its end, as acquisition programs write them."""
    kind = {"u": 1, "i": 2, "f": 3}[movie.dtype.kind]
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    pages = []
    for image in movie:
        height, width = image.shape
        if tile:
            padded = np.pad(image, ((0, -height % tile), (0, -width % tile)))
            cells = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            cells = [image[y : y + (rows or height)] for y in range(0, height, rows or height)]
        offsets, sizes = [], []
        for c in cells:
            if predictor == 2:
                c = np.diff(c, axis=1, prepend=c.dtype.type(0))
            raw = np.ascontiguousarray(c, c.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = np.frombuffer(np.ascontiguousarray(c, c.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(*c.shape, c.itemsize)
                planes = planes.transpose(0, 2, 1).reshape(len(c), -1)
                raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            data = PACK[compression](raw)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        pages.append((height, width, offsets, sizes))
    word, inline = ("Q", 8) if big else ("I", 4)
    link = 8 if big else 4
    for height, width, offsets, sizes in pages:
        tags = {256: (3, [width]), 257: (3, [height]), 258: (3, [movie.itemsize * 8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor]), 339: (3, [kind])}
        tags |= {322: (3, [tile]), 323: (3, [tile]), 324: (16 if big else 4, offsets), 325: (4, sizes)} if tile else {273: (16 if big else 4, offsets), 278: (3, [rows or height]), 279: (4, sizes)}
        if description:
            tags[270] = (2, description)
        fields = b""
        for tag, (t, values) in sorted(tags.items()):
            raw = values if t == 2 else struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[t]}", *values)
            if len(raw) > inline:
                spot = struct.pack(order + word, len(out))
                out += raw
            else:
                spot = raw.ljust(inline, b"\0")
            fields += struct.pack(f"{order}HH{word}", tag, t, len(values)) + spot
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + fields
        link = len(out)
        out += b"\0" * inline
    return bytes(out)


def in_a_circle() -> bytes:
    out = bytearray(tiff(MOVIE[:2]))
    out[-4:] = out[4:8]
    return bytes(out)


def images(df) -> dict:
    return {r.frame: np.frombuffer(bytes(r.pixels)).reshape(r.height, r.width) for r in df.collect()}


def same(got: dict, movie) -> None:
    assert sorted(got) == list(range(len(movie)))
    for k, image in enumerate(movie):
        np.testing.assert_array_equal(got[k], image.astype(float))


FORMS = [
    {}, {"order": ">"}, {"rows": 7}, {"big": True}, {"big": True, "order": ">", "compression": 8, "rows": 10}, {"compression": 5}, {"compression": 5, "predictor": 2, "rows": 5},
    {"compression": 32773}, {"compression": 8, "predictor": 2}, {"tile": 16}, {"tile": 16, "compression": 8, "big": True, "predictor": 2}, {"order": ">", "compression": 8, "predictor": 2},
]


def test_every_form_of_file(spark, tmp_path):
    """Forms are decoded one by one in the driver, then all together by Spark."""
    for k, form in enumerate(FORMS):
        (tmp_path / f"a_{k}.tif").write_bytes(tiff(MOVIE, **form))
        with S.opened(str(tmp_path / f"a_{k}.tif")) as f:
            pages = list(S.pages_of(f, f.size()))
            same({i: S.decode(f, p) for i, p in enumerate(pages)}, MOVIE)
    got = images(S.stack(spark, str(tmp_path)))
    same(got, np.concatenate([MOVIE] * len(FORMS)))


@pytest.mark.parametrize("dtype,predictor", [("f4", 3), ("f8", 3), ("f4", 1), ("u1", 2), ("i2", 2), ("u4", 1), ("i1", 1)])
def test_kinds_of_numbers(tmp_path, dtype, predictor):
    movie = (rng.normal(0, 50, (2, 9, 13))).astype(dtype) if dtype[0] != "u" else rng.integers(0, 200, (2, 9, 13)).astype(dtype)
    path = str(tmp_path / "a.tif")
    open(path, "wb").write(tiff(movie, compression=8, predictor=predictor))
    with S.opened(path) as f:
        same({i: S.decode(f, p) for i, p in enumerate(S.pages_of(f, f.size()))}, movie)


def test_long_lzw(tmp_path):
    """Enough codes to widen to 12 bits and to clear the table."""
    movie = rng.integers(0, 60, (1, 200, 150)).astype(np.uint8)
    open(tmp_path / "a.tif", "wb").write(tiff(movie, compression=5))
    with S.opened(str(tmp_path / "a.tif")) as f:
        same({0: S.decode(f, next(S.pages_of(f, f.size())))}, movie)


def test_one_directory_for_many_pages(spark, tmp_path):
    head = tiff(MOVIE[:1], description=b"ImageJ=1.53\nimages=12\nframes=12\n\0")
    at = head.index(MOVIE[0].tobytes())
    body = head[:at] + MOVIE.tobytes() + head[at + MOVIE[0].nbytes :]
    shift = MOVIE[1:].nbytes
    body = bytearray(body)
    struct.pack_into("<I", body, 4, struct.unpack_from("<I", body, 4)[0] + shift)
    # the description lies behind the pixels, its place is in the directory
    directory = struct.unpack_from("<I", body, 4)[0]
    for k in range(struct.unpack_from("<H", body, directory)[0]):
        if struct.unpack_from("<H", body, directory + 2 + 12 * k)[0] == 270:
            struct.pack_into("<I", body, directory + 10 + 12 * k, struct.unpack_from("<I", body, directory + 10 + 12 * k)[0] + shift)
    (tmp_path / "a.tif").write_bytes(bytes(body))
    same(images(S.stack(spark, str(tmp_path / "a.tif"))), MOVIE)


def test_runs_of_pages_go_to_many_tasks(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(MOVIE, big=True, compression=8))
    index = S.numbered(S.page_index(spark, str(tmp_path / "a.tif")))
    for pages in (5, 1, 100):  # 12 frames: 5, 5, 2
        same(images(S.decoded(index, pages)), MOVIE)
    tasks = S.decoded(index, 2).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.collect_set(F.floor(F.col("frame") / 2)).alias("runs")).collect()
    assert len(tasks) > 1 and sorted(r for t in tasks for r in t.runs) == list(range(6))


class Spy:
    def __init__(self, f):
        self.f, self.ranges = f, []

    def read_at(self, n, at):
        self.ranges.append((at, at + n))
        return self.f.read_at(n, at)


def test_only_the_bytes_that_are_needed(tmp_path):
    movie = rng.integers(0, 999, (30, 256, 256)).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(tiff(movie))
    with S.opened(str(tmp_path / "a.tif")) as f:
        spy = Spy(f)
        pages = list(S.pages_of(spy, f.size()))
        assert sum(b - a for a, b in spy.ranges) < 0.02 * f.size()
        spy.ranges.clear()
        np.testing.assert_array_equal(S.decode(spy, pages[17]), movie[17])
        assert spy.ranges == [(pages[17]["offsets"][0], pages[17]["offsets"][0] + movie[17].nbytes)]


def test_frames_and_order_of_files(spark, tmp_path):
    for name, part in (("m_2.tif", MOVIE[4:8]), ("m_10.tif", MOVIE[8:]), ("m_1.tif", MOVIE[:4])):
        (tmp_path / name).write_bytes(tiff(part))
    same(images(S.stack(spark, str(tmp_path))), MOVIE)
    some = images(S.stack(spark, str(tmp_path), frames=(3, 5)))
    assert sorted(some) == [3, 4, 5] and np.array_equal(some[4], MOVIE[4])


def test_frames_outside_are_not_decoded(spark, tmp_path):
    damaged = bytearray(tiff(MOVIE, compression=8))
    (tmp_path / "a.tif").write_bytes(bytes(damaged))
    with S.opened(str(tmp_path / "a.tif")) as f:
        last = list(S.pages_of(f, f.size()))[-1]
    damaged[last["offsets"][0] : last["offsets"][0] + 10] = b"\xff" * 10
    (tmp_path / "a.tif").write_bytes(bytes(damaged))
    assert len(images(S.stack(spark, str(tmp_path / "a.tif"), frames=(0, 10)))) == 11
    with pytest.raises(Exception, match="zlib|Error -3"):
        S.stack(spark, str(tmp_path / "a.tif")).collect()


@pytest.mark.parametrize("content,match", [(b"not a tiff at all", "not a TIFF"), (tiff(MOVIE)[:-40], "ends too early"), (b"II*\0\x08\0\0\0\0\0\x08\0\0\0", "without pixels"), (in_a_circle(), "circle")])
def test_files_that_cannot_be_read(spark, tmp_path, content, match):
    (tmp_path / "a.tif").write_bytes(content)
    with pytest.raises(Exception, match=match):
        S.stack(spark, str(tmp_path / "a.tif")).collect()


@pytest.mark.parametrize("deflated", [True, False])
def test_through_the_sink(spark, tmp_path, deflated):
    rows = [(k, 33, 20, MOVIE[k].astype(float).tobytes()) for k in range(12)]
    frames = spark.createDataFrame(rows, S.STACK).repartition(4)
    out = str(tmp_path / "out")
    S.write_stack(frames, out, per_file=5, dtype="uint16", deflated=deflated, description="pixel size 100 nm")
    assert sorted(os.listdir(out)) == ["frames_0.tif", "frames_1.tif", "frames_2.tif"]
    same(images(S.stack(spark, out)), MOVIE)
    index = S.page_index(spark, out).collect()
    assert {r.description for r in index if r.page == 0} == {"pixel size 100 nm"} and {r.dtype for r in index} == {"<u2"}
    S.write_stack(frames, out, per_file=5, dtype="uint16", deflated=deflated)  # again, in place
    same(images(S.stack(spark, out)), MOVIE)


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    rows = [(k, 33, 20, MOVIE[k].astype(float).tobytes()) for k in range(6)] + [(6, 33, 20, b"short")]
    out = str(tmp_path / "out")
    with pytest.raises(Exception):
        S.write_stack(spark.createDataFrame(rows, S.STACK), out, per_file=2)
    assert not [f for f in os.listdir(out) if not f.startswith(".")]


def test_an_empty_file_has_no_frames(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"")
    assert S.stack(spark, str(tmp_path)).count() == 0
