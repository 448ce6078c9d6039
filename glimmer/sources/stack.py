"""Image stacks: TIFF and BigTIFF files as a table of pages, read by byte ranges.

The scan has two steps, both of them Spark jobs over small rows.  ``page_index`` walks the
directories of each file, one task a file, and reads nothing but directories; its rows say where
the pixels of each page lie.  ``decoded`` deals those rows to tasks by runs of ``PAGES`` pages of
a file and reads the strips or tiles of just those pages.  So one long file is decoded by many
tasks, no task holds more than a page besides what it hands on, and a filter on frames or files
put on the index keeps the rest from being read at all.  ``write_stack`` is the way back: a data
source whose tasks write a file each.

Files are read and written through pyarrow's file systems, by the URI that Spark lists them under.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from glimmer.session import cut

#: Pages of a file that one task decodes.
PAGES = 64
#: Bytes that are read at a time while directories are walked.
AHEAD = 1 << 12
#: Tasks of a step; beyond it a task gets several files or runs.
MOST_TASKS = 20_000

INDEX = """path string, page int, height int, width int, dtype string, compression int, predictor int, tile_height int, tile_width int,
    offsets array<long>, sizes array<long>, description string"""
STACK = "frame int, height int, width int, pixels binary"

# Fixed values of the TIFF format: field types as (size, struct code), and tags.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 270, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 317, 322, 323, 324, 325, 339
_READ = frozenset((WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT))


def located(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """A file that can be read at any place."""
    fs, path = located(uri)
    return fs.open_input_file(path)


class _Window:
    """Reads of a few bytes at a time, served from blocks."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size, self.at, self.block, self.read_bytes = f, size, 0, b"", 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("a TIFF that ends too early")
        if not self.at <= at or at + n > self.at + len(self.block):
            self.at, self.block = at, self.f.read_at(min(max(n, AHEAD), self.size - at), at)
            self.read_bytes += len(self.block)
        return self.block[at - self.at : at - self.at + n]


def directories(f, size: int) -> Iterator[dict[int, tuple]]:
    """The tags of each page of a file, in file order."""
    w = _Window(f, size)
    head = w.read(0, min(16, size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    big = version == 43
    count, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    inline = 8 if big else 4
    at = struct.unpack(order + word, head[8:16] if big else head[4:8])[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError("TIFF directories in a circle")
        seen.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), w.read(at, count))[0]
        raw = w.read(at + count, n * entry + inline)
        tags: dict[int, tuple] = {0: (order,)}
        for k in range(n):
            tag, kind, many = struct.unpack(f"{order}HH{word}", raw[k * entry : k * entry + entry - inline])
            if tag not in _READ or kind not in _TYPES:
                continue
            width, code = _TYPES[kind]
            spot = raw[(k + 1) * entry - inline : (k + 1) * entry]
            if width * many > inline:
                spot = w.read(struct.unpack(order + word, spot)[0], width * many)
            spot = spot[: width * many]
            tags[tag] = (spot,) if code == "s" else struct.unpack(f"{order}{many}{code}", spot)
        yield tags
        at = struct.unpack(order + word, raw[n * entry :])[0]


def _page(tags: dict[int, tuple]) -> dict:
    order, one = tags[0][0], lambda tag, other=1: tags.get(tag, (other,))[0]
    tiled = TILES in tags
    if not tiled and STRIPS not in tags or WIDTH not in tags or HEIGHT not in tags:
        raise ValueError("a TIFF page without pixels")
    if one(SAMPLES) != 1:
        raise ValueError("a TIFF of several samples a pixel")
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT))
    if kind is None or one(BITS) not in (8, 16, 32, 64):
        raise ValueError("a TIFF of pixels that are no numbers of whole bytes")
    return {
        "height": one(HEIGHT), "width": one(WIDTH), "dtype": f"{order}{kind}{one(BITS) // 8}", "compression": one(COMPRESSION), "predictor": one(PREDICTOR),
        "tile_height": one(TILE_HEIGHT) if tiled else min(one(ROWS, one(HEIGHT)), one(HEIGHT)), "tile_width": one(TILE_WIDTH) if tiled else one(WIDTH),
        "offsets": list(tags[TILES if tiled else STRIPS]), "sizes": list(tags[TILE_SIZES if tiled else STRIP_SIZES]),
        "description": one(DESCRIPTION, b"").split(b"\0")[0].decode("utf-8", "replace") or None,
    }


def pages_of(f, size: int) -> Iterator[dict]:
    """Where each page lies.  A file may have one directory for many pages that follow each other
    without gaps, and say their number in its description (``images=``)."""
    pages = map(_page, directories(f, size))
    first = next(pages, None)
    if first is None:
        return
    yield first
    second = next(pages, None)
    said = first["description"] or ""
    if second is None and said.startswith("ImageJ=") and first["compression"] == 1:
        n = next((int(line[7:]) for line in said.splitlines() if line.startswith("images=") and line[7:].isdigit()), 1)
        step = first["height"] * first["width"] * np.dtype(first["dtype"]).itemsize
        for k in range(1, n):
            if first["offsets"][0] + (k + 1) * step > size:
                break
            yield first | {"offsets": [first["offsets"][0] + k * step], "sizes": [step], "tile_height": first["height"], "description": None}
    if second is not None:
        yield second
        yield from pages


def unpacked_bits(data: bytes) -> bytes:
    """PackBits."""
    out, at = io.BytesIO(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.write(data[at + 1 : at + n + 2])
            at += n + 2
        else:
            if n > 128:
                out.write(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return out.getvalue()


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, widened one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out = list(first), []
    width, last = 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


# How TIFF numbers its compressions.
DECODERS = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits, 50000: _zstd}


def _differences_undone(tile: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return tile
    if predictor == 2 and tile.dtype.kind in "ui":
        return np.cumsum(tile, axis=1, dtype=tile.dtype.newbyteorder("=")).astype(tile.dtype)
    if predictor == 3 and tile.dtype.kind == "f":
        size = tile.dtype.itemsize
        planes = np.cumsum(tile.view(np.uint8).reshape(len(tile), -1), axis=1, dtype=np.uint8)
        planes = planes.reshape(len(tile), size, -1).transpose(0, 2, 1)  # most significant bytes first
        return np.ascontiguousarray(planes).view(f">f{size}").reshape(tile.shape)
    raise ValueError(f"TIFF predictor {predictor}")


def decode(f, page: dict) -> np.ndarray:
    """The pixels of a page."""
    if page["compression"] not in DECODERS:
        raise ValueError(f"TIFF compression {page['compression']}")
    height, width, kind = page["height"], page["width"], np.dtype(page["dtype"])
    th, tw = page["tile_height"], page["tile_width"]
    out = np.zeros((height, width), kind)
    across = -(-width // tw)
    for k, (at, size) in enumerate(zip(page["offsets"], page["sizes"], strict=True)):
        y, x = k // across * th, k % across * tw
        rows = th if tw != width else min(th, height - y)
        if y >= height or not size:
            continue
        data = DECODERS[page["compression"]](f.read_at(size, at))
        need = rows * tw * kind.itemsize
        if len(data) < need:
            raise ValueError("a page of a TIFF that ends too early")
        tile = _differences_undone(np.frombuffer(data, kind, rows * tw).reshape(rows, tw), page["predictor"])
        out[y : y + th, x : x + tw] = tile[: height - y, : width - x]
    return out


def natural(path: Column) -> Column:
    """A sort key in which runs of digits are numbers: img_2 before img_10."""
    return F.regexp_replace(F.regexp_replace(path, r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})", "$1")


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of files; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def page_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each page of the files of a path: where its pixels lie and how they are stored.

    Only directories are read, one task a file at most, and once: the index is checkpointed.  A
    file that is no TIFF raises.
    """

    def run(batches):
        for batch in batches:
            for uri, size in zip(batch["path"], batch["length"], strict=True):
                rows = []
                with opened(uri) as f:
                    for k, page in enumerate(pages_of(f, int(size))):
                        rows.append({"path": uri, "page": k} | page)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = listed(spark, path)
    # A number of partitions is given, as the small rows would be put together otherwise.
    return cut(files.repartition(max(1, min(files.count(), MOST_TASKS)), "path").mapInPandas(run, INDEX))


def numbered(index: DataFrame) -> DataFrame:
    """Frame numbers through all files, in natural order of their paths.

    The window goes over a row for each file.
    """
    order = Window.orderBy(natural(F.col("path")), "path").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    starts = files.select("path", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    return index.join(starts, "path").withColumn("frame", (F.col("start") + F.col("page")).cast("int")).drop("start")


def decoded(index: DataFrame, pages: int = PAGES) -> DataFrame:
    """frame, height, width and pixels (float64) of the indexed pages; each task gets runs of
    ``pages`` pages of a file and reads only their bytes."""

    def run(batches):
        name, f = None, None
        try:
            for batch in batches:
                for page in batch.to_dict("records"):
                    if page["path"] != name:
                        if f is not None:
                            f.close()
                        name, f = page["path"], opened(page["path"])
                    image = decode(f, page).astype(np.float64)
                    yield pd.DataFrame({"frame": [page["frame"]], "height": [page["height"]], "width": [page["width"]], "pixels": [image.tobytes()]})
        finally:
            if f is not None:
                f.close()

    rows = index.withColumn("run", F.floor(F.col("page") / pages))
    runs = rows.select("path", "run").distinct().count()
    dealt = rows.repartition(max(1, min(runs, MOST_TASKS)), "path", "run").sortWithinPartitions("path", "page")
    return dealt.drop("run", "description").mapInPandas(run, STACK)


def stack(spark: SparkSession, path: str, pages: int = PAGES, frames: tuple[int, int] | None = None) -> DataFrame:
    """The frames of TIFF files (a file, folder or pattern), or those from the first to the last
    of ``frames``; the others are not decoded."""
    index = numbered(page_index(spark, path))
    if frames is not None:
        index = index.filter(F.col("frame").between(*frames))
    return decoded(index, pages)


# --- writing ----------------------------------------------------------------------------------


def _directory(at: int, following: bool, page: np.ndarray, data: bytes, compression: int, description: bytes) -> bytes:
    """A BigTIFF directory at a place, its description and pixels right behind it; another one
    may follow."""
    kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
    height, width = page.shape
    n = 10 + bool(description)
    behind = at + 8 + 20 * n + 8
    text_at, data_at = behind, behind + (len(description) if len(description) > 8 else 0)
    tags = [
        (WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, page.dtype.itemsize * 8), (COMPRESSION, 3, 1, compression), (262, 3, 1, 1),
        (STRIPS, 16, 1, data_at), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, height), (STRIP_SIZES, 16, 1, len(data)), (FORMAT, 3, 1, kind),
    ]
    fields = [struct.pack("<HHQQ", *tag) for tag in tags]
    if description:
        spot = struct.pack("<Q", text_at) if len(description) > 8 else description.ljust(8, b"\0")
        fields.insert(5, struct.pack("<HHQ", DESCRIPTION, 2, len(description)) + spot)
    end = data_at + len(data)
    return struct.pack("<Q", n) + b"".join(fields) + struct.pack("<Q", end if following else 0) + (description if len(description) > 8 else b"") + data


def tiff_file(pages: Iterator[np.ndarray], deflated: bool, description: bytes = b"") -> Iterator[bytes]:
    """The pieces of a BigTIFF file, in order; only two pages are held at a time."""
    yield b"II" + struct.pack("<HHHQ", 43, 8, 0, 16)
    at, page = 16, next(pages, None)
    while page is not None:
        following = next(pages, None)
        page = np.ascontiguousarray(page, page.dtype.newbyteorder("<"))
        data = zlib.compress(page.tobytes(), 6) if deflated else page.tobytes()
        piece = _directory(at, following is not None, page, data, 8 if deflated else 1, description)
        yield piece
        at, page, description = at + len(piece), following, b""


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class StackWriter(DataSourceWriter):
    """Each task writes the files of its frames under hidden names; the commit shows them all, and
    a write that fails leaves none."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("a stack needs a path")
        self.folder, self.dtype = options["path"].rstrip("/"), options.get("dtype", "float32")
        self.per_file, self.deflated = int(options.get("framesPerFile", 1000)), options.get("compression", "deflate") == "deflate"
        self.description = options.get("description", "").encode()
        self.description += b"\0" * bool(self.description)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, folder = located(self.folder)
        fs.create_dir(folder, recursive=True)
        names, attempt = [], uuid.uuid4().hex
        row = next(rows, None)
        while row is not None:
            number = row["frame"] // self.per_file

            def pages(number: int = number):
                nonlocal row
                while row is not None and row["frame"] // self.per_file == number:
                    yield np.frombuffer(row["pixels"], np.float64).reshape(row["height"], row["width"]).astype(self.dtype)
                    row = next(rows, None)

            name = f"frames_{number}.tif"
            names.append(f".{name}.{attempt}")
            with fs.open_output_stream(f"{folder}/{names[-1]}") as f:
                for piece in tiff_file(pages(), self.deflated, self.description):
                    f.write(piece)
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, folder = located(self.folder)
        names = [name for m in messages if m is not None for name in m.names]
        shown = [name[1:].rsplit(".", 1)[0] for name in names]
        if len(set(shown)) != len(shown):
            self.abort(messages)
            raise ValueError("the frames of a file are in several tasks; write through write_stack")
        for name, show in zip(names, shown, strict=True):
            fs.move(f"{folder}/{name}", f"{folder}/{show}")

    def abort(self, messages: list) -> None:
        fs, folder = located(self.folder)
        for name in (name for m in messages if m is not None for name in m.names):
            fs.delete_file(f"{folder}/{name}")


class StackSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StackWriter(self.options)


def write_stack(frames: DataFrame, path: str, per_file: int = 1000, dtype: str = "float32", deflated: bool = True, description: str = "") -> None:
    """Frames (frame, height, width, pixels) as a folder of BigTIFF files ``frames_<k>.tif`` of
    ``per_file`` frame numbers each.  A file is written by one task, page by page; files of the
    same name are replaced once all are written."""
    frames.sparkSession.dataSource.register(StackSink)
    dealt = frames.select("frame", "height", "width", "pixels").repartition(F.floor(F.col("frame") / per_file)).sortWithinPartitions("frame")
    w = dealt.write.format("tiff_stack").mode("append").option("framesPerFile", per_file).option("dtype", dtype)
    w.option("compression", "deflate" if deflated else "none").option("description", description).save(path)
