"""Audio tracks of video containers as a source: ``spark.read.format("media_tracks").load(folder)``.

Only headers are read: of Matroska the elements before the first cluster (or the track list that the seek head
points to), of MP4 the boxes that describe tracks; what lies between is skipped by its size. Files are dealt over partitions.
A file whose headers cannot be understood is a row with an error, not a failed job.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuelake.session import ship

SCHEMA = "path string, index int, kind string, language string, title string, codec string, channels int, sample_rate int, default boolean, error string"
#: Files of one partition.
FILES = 64
#: Elements of a container that are looked at in one place, and bytes of one that is read whole.
MOST, WHOLE = 100_000, 1 << 20
# Identifiers of Matroska elements.
EBML, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_AT = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
TRACKS, ENTRY, CLUSTER, AUDIO = 0x1654AE6B, 0xAE, 0x1F43B675, 0xE1
NUMBER, TYPE, DEFAULT, LANGUAGE, LANGUAGE_TAG, NAME, CODEC, RATE, CHANNELS = 0xD7, 0x83, 0x88, 0x22B59C, 0x22B59D, 0x536E, 0x86, 0xB5, 0x9F
KINDS = {1: "video", 2: "audio", 17: "subtitle", b"vide": "video", b"soun": "audio", b"sbtl": "subtitle", b"text": "subtitle", b"subt": "subtitle"}
# How codecs are called.
CODECS = {
    "A_AAC": "aac", "A_AC3": "ac3", "A_EAC3": "eac3", "A_DTS": "dts", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_TRUEHD": "truehd",
    "A_MPEG/L2": "mp2", "A_MPEG/L3": "mp3", "A_PCM/INT/LIT": "pcm_s16le", "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_AV1": "av1", "V_VP9": "vp9",
    "S_TEXT/UTF8": "subrip", "S_TEXT/ASS": "ass", "mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "Opus": "opus", "fLaC": "flac", "alac": "alac", ".mp3": "mp3",
    "avc1": "h264", "hvc1": "hevc", "hev1": "hevc", "av01": "av1", "vp09": "vp9", "tx3g": "mov_text",
}


class Broken(ValueError):
    """Headers that cannot be understood."""


class Reader:
    """A file with bounded reads; ``read_bytes`` counts what was read of it."""

    def __init__(self, file, size: int):
        self.file, self.size, self.read_bytes = file, size, 0

    def at(self, place: int, n: int) -> bytes:
        if not 0 <= place <= self.size or n < 0 or n > WHOLE:
            raise Broken(f"{n} bytes at {place} of {self.size}")
        self.file.seek(place)
        got = self.file.read(n)
        self.read_bytes += len(got)
        if len(got) < n:
            raise Broken(f"ends at {place + len(got)}")
        return got


# --- Matroska


def _element(r: Reader, at: int) -> tuple[int, int, int | None]:
    """Identifier, place of the content and its size (None: not known) of the element at a place."""
    head = r.at(at, min(12, r.size - at))
    if not head or not head[0]:
        raise Broken(f"no element at {at}")
    n = 9 - head[0].bit_length()
    if n > 4 or len(head) <= n or not head[n]:
        raise Broken(f"no element at {at}")
    m = 9 - head[n].bit_length()
    if len(head) < n + m:
        raise Broken(f"ends within the element at {at}")
    size = int.from_bytes(head[n : n + m], "big") & ((1 << 7 * m) - 1)
    return int.from_bytes(head[:n], "big"), at + n + m, None if size == (1 << 7 * m) - 1 else size


def _children(r: Reader, lo: int, hi: int) -> Iterator[tuple[int, int, int | None]]:
    for _ in range(MOST):
        if lo >= hi:
            return
        name, content, size = _element(r, lo)
        yield name, content, size
        if size is None:
            return
        lo = content + size
    raise Broken("too many elements")


def _number(r: Reader, at: int, size: int) -> int:
    return int.from_bytes(r.at(at, size), "big") if size <= 8 else 0


def _text(r: Reader, at: int, size: int) -> str:
    return r.at(at, size).split(b"\0")[0].decode("utf-8", "replace")


def _matroska_track(r: Reader, at: int, size: int) -> dict:
    out = {"kind": None, "language": "eng", "title": "", "codec": "", "channels": None, "sample_rate": None, "default": True}
    tag = None
    for name, content, n in _children(r, at, at + size):
        if n is None:
            raise Broken("track of unknown size")
        if name == TYPE:
            out["kind"] = KINDS.get(_number(r, content, n), "other")
        elif name == DEFAULT:
            out["default"] = _number(r, content, n) == 1
        elif name == LANGUAGE:
            out["language"] = _text(r, content, n)
        elif name == LANGUAGE_TAG:
            tag = _text(r, content, n)
        elif name == NAME:
            out["title"] = _text(r, content, n)
        elif name == CODEC:
            codec = _text(r, content, n)
            out["codec"] = CODECS.get(codec, CODECS.get(codec.rsplit("/", 1)[0], codec))
        elif name == AUDIO:
            out |= {"channels": 1, "sample_rate": 8000}
            for inner, c, m in _children(r, content, content + n):
                if inner == CHANNELS:
                    out["channels"] = _number(r, c, m or 0)
                elif inner == RATE and m in (4, 8):
                    out["sample_rate"] = int(struct.unpack(">f" if m == 4 else ">d", r.at(c, m))[0])
    return out | ({"language": tag} if tag else {})


def _matroska(r: Reader) -> list[dict]:
    name, content, size = _element(r, 0)
    if name != EBML or size is None:
        raise Broken("no EBML header")
    name, first, size = _element(r, content + size)
    if name != SEGMENT:
        raise Broken("no segment")
    end, listed = r.size if size is None else min(r.size, first + size), None
    for name, content, n in _children(r, first, end):
        if name == SEEK_HEAD and n is not None:
            for inner, c, m in _children(r, content, content + n):
                if inner == SEEK and m is not None:
                    found = {k: _number(r, a, s or 0) for k, a, s in _children(r, c, c + m)}
                    listed = found.get(SEEK_AT, listed) if found.get(SEEK_ID) == TRACKS else listed
        if name == CLUSTER and listed is not None:
            name, content, n = _element(r, first + listed)
        if name == TRACKS and n is not None:
            return [_matroska_track(r, c, m or 0) for inner, c, m in _children(r, content, content + n) if inner == ENTRY]
        if name == CLUSTER:
            break
    raise Broken("no track list")


# --- MP4


def _boxes(r: Reader, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, place of the content and its end of the boxes between two places."""
    for _ in range(MOST):
        if lo + 8 > hi:
            return
        size, name = struct.unpack(">I4s", r.at(lo, 8))
        content = lo + 8
        if size == 1:
            size, content = struct.unpack(">Q", r.at(lo + 8, 8))[0], lo + 16
        elif size == 0:
            size = hi - lo
        if size < content - lo or lo + size > hi:
            raise Broken(f"box {name!r} at {lo} does not fit")
        yield name, content, lo + size
        lo += size
    raise Broken("too many boxes")


def _below(r: Reader, lo: int, hi: int, *path: bytes) -> tuple[int, int] | None:
    for name, a, b in _boxes(r, lo, hi):
        if name == path[0]:
            return (a, b) if len(path) == 1 else _below(r, a, b, *path[1:])
    return None


def _mp4_track(r: Reader, lo: int, hi: int) -> dict:
    out = {"kind": "other", "language": "und", "title": "", "codec": "", "channels": None, "sample_rate": None, "default": False}
    if at := _below(r, lo, hi, b"tkhd"):
        out["default"] = bool(r.at(at[0], 4)[3] & 1)  # the track is enabled
    if at := _below(r, lo, hi, b"mdia", b"mdhd"):
        packed = int.from_bytes(r.at(at[0] + (32 if r.at(at[0], 1)[0] else 20), 2), "big")
        letters = [(packed >> s & 31) + 0x60 for s in (10, 5, 0)]
        out["language"] = "".join(map(chr, letters)) if all(0x61 <= c <= 0x7A for c in letters) else "und"
    if at := _below(r, lo, hi, b"mdia", b"hdlr"):
        body = r.at(at[0], min(at[1] - at[0], 256))
        out["kind"] = KINDS.get(body[8:12], "other")
        out["title"] = body[24:].split(b"\0")[0].decode("utf-8", "replace")
    if at := _below(r, lo, hi, b"mdia", b"minf", b"stbl", b"stsd"):
        entry = r.at(at[0] + 8, min(36, at[1] - at[0] - 8))
        codec = entry[4:8].decode("latin-1")
        out["codec"] = CODECS.get(codec, codec)
        if out["kind"] == "audio" and len(entry) >= 36:
            out |= {"channels": int.from_bytes(entry[24:26], "big"), "sample_rate": int.from_bytes(entry[32:34], "big")}
    return out


def _mp4(r: Reader) -> list[dict]:
    movie = _below(r, 0, r.size, b"moov")
    if movie is None:
        raise Broken("no movie box")
    return [_mp4_track(r, a, b) for name, a, b in _boxes(r, *movie) if name == b"trak"]


def tracks_of(r: Reader) -> list[dict]:
    """kind, language, title, codec, channels, sample_rate and default of all tracks, in order."""
    head = r.at(0, min(8, r.size))
    if head[:4] == EBML.to_bytes(4, "big"):
        return _matroska(r)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        return _mp4(r)
    raise Broken("neither Matroska nor MP4")


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class MediaTracksReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        found = sorted((f.path, f.size) for f in files if f.type == FileType.File)
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.path)
        for path, size in partition.paths:
            with fs.open_input_file(path) as f:
                try:
                    tracks = tracks_of(Reader(f, size))
                except Broken as e:
                    yield path, None, None, None, None, None, None, None, None, f"{posixpath.basename(path)}: {e}"
                    continue
            for k, t in enumerate(tracks):
                yield path, k, t["kind"], t["language"], t["title"], t["codec"], t["channels"], t["sample_rate"], t["default"], None


class MediaTracks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_tracks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaTracksReader:
        return MediaTracksReader(self.options["path"])


def list_tracks(spark: SparkSession, path: str, kind: str | None = "audio") -> DataFrame:
    """SRC-2: the tracks (all kinds for None) of the container files below a path: path, index (the stream's number in
    its file), kind, language, title, codec, channels, sample_rate, default, error. A file that cannot be read has one row, with the
    error."""
    ship(spark)
    spark.dataSource.register(MediaTracks)
    tracks = spark.read.format("media_tracks").load(path)
    return tracks if kind is None else tracks.where((tracks.kind == kind) | tracks.error.isNotNull())
