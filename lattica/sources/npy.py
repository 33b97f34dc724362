"""A partitioned data source for ``.npy`` arrays.

``spark.read.format("npy").load(path)`` gives one row for each element: path,
pos (C-order) and value (numeric view), and with option ``exact`` its exact
text too, which costs far more.  Option ``mode`` is ``elements`` (default),
``records`` (a row for each record of a structured array) or ``meta`` (a row
for each file).  Option ``window`` selects by axis (``0:64, ::8, 3``): only its
bytes are read, and what lies past the end of a truncated file is NaN and
``--``.  Files are read in ranges through pyarrow's file systems; of many files
none is opened while planning, as their headers are parsed where they are read.
Where the session pushes filters to Python's sources
(``spark.sql.python.filterPushdown.enabled``), comparisons of ``pos`` and tests
of ``path`` select byte ranges and files.  ``spark.readStream.format("npy")``
takes new files and what is appended to files that were still short.  For
stores that only Spark reads, :func:`read_npy_binary` takes whole files through
Spark's own reader.  Nothing is ever unpickled.
"""

from __future__ import annotations

import ast
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from ..functions.dtype import DType, parse_descr
from ..operators.slices import PAGE_COLUMNS, PAGE_ROWS, Plane, block_steps, read_block, table_window

MAGIC = b"\x93NUMPY"
#: Longest header that is accepted.
MAX_HEADER = 1 << 20
#: Bytes of data in a partition and in a batch, about.
PARTITION_BYTES, BATCH_BYTES = 16 << 20, 2 << 20

META = "path string, descr string, dtype string, kind string, itemsize int, little_endian boolean, numeric boolean, readable boolean, shape array<bigint>, ndim int, size bigint, data_bytes bigint, fortran_order boolean, npy_version string, header_bytes bigint, file_bytes bigint, fields array<struct<name:string,descr:string,dtype:string,kind:string,offset:bigint,itemsize:int,shape:array<bigint>>>, time_unit string, truncated boolean, unsupported string"
COLUMNS = {"path": "string", "pos": "bigint", "value": "double", "exact": "string"}
ELEMENTS = "path string, pos bigint, value double"
EXACT = f"{ELEMENTS}, exact string"
#: Bytes between wanted elements that are read rather than skipped, and bytes read at once for a window.
GAP_BYTES, SPAN_BYTES = 4096, 8 << 20
#: Files whose headers are read while planning, so that windows make no empty tasks; of more, none is opened there.
FEW_FILES = 64
#: Bytes that opening a file counts for where small files share a partition, and files of a partition: the most of headers, and how many
#: small files share one at least where there are very many.
OPEN_BYTES, HEADERS = 1 << 20, 256
#: Text of an element that a truncated file does not hold.
MISSING = "--"


class NpyError(ValueError):
    """A file is not a NumPy array file that can be read."""


class HeaderCutOff(NpyError):
    """The file ends before its header does, as while it is being written."""


@dataclass(frozen=True)
class Header:
    dtype: DType
    shape: tuple[int, ...]
    fortran: bool
    version: str
    header_bytes: int
    file_bytes: int

    @property
    def size(self) -> int:
        n = 1
        for d in self.shape:
            n *= d
        return n

    @property
    def available(self) -> int:
        """Whole elements that the file holds."""
        room = max(self.file_bytes - self.header_bytes, 0)
        return min(self.size, room // self.dtype.itemsize if self.dtype.itemsize else self.size)


def parse_header(head: bytes, file_bytes: int) -> Header:
    """Parses the start of a file: versions 1 (16-bit length), 2 and 3 (32-bit); the dictionary must be a plain literal."""
    if head[:6] != MAGIC:
        raise (HeaderCutOff if MAGIC.startswith(head) else NpyError)("not a NUMPY array file: wrong magic bytes")
    major, minor = head[6:8] if len(head) >= 8 else (0, 0)
    if major not in (1, 2, 3):
        raise NpyError(f"unsupported format version {major}.{minor}")
    start, form = (10, "<H") if major == 1 else (12, "<I")
    if len(head) < start:
        raise HeaderCutOff("the NUMPY header is cut off")
    n = struct.unpack(form, head[8:start])[0]
    if n > MAX_HEADER or len(head) < start + n:
        raise (NpyError if n > MAX_HEADER else HeaderCutOff)("the NUMPY header is too long or cut off")
    try:
        d = ast.literal_eval(head[start : start + n].decode("utf-8" if major == 3 else "latin-1").strip())
        shape = tuple(int(x) for x in d["shape"])
        if any(x < 0 for x in shape):
            raise ValueError("negative extent")
        return Header(parse_descr(d["descr"]), shape, bool(d["fortran_order"]), f"{major}.{minor}", start + n, file_bytes)
    except (ValueError, SyntaxError, KeyError, TypeError) as e:
        raise NpyError(f"malformed NUMPY header: {e}") from e


def _header_row(path: str, h: Header) -> tuple:
    t = h.dtype
    fields = [(f.name, f.dtype.descr, f.dtype.name, f.dtype.kind, f.offset, f.dtype.itemsize, list(f.shape)) for f in t.fields]
    reason = None if t.readable and t.numeric and h.size else "The array is empty." if t.readable and t.numeric else f"Statistics do not apply to {t.name} arrays." if t.readable else f"{t.name} arrays are not read."
    return (path, t.descr, t.name, t.kind, t.itemsize, t.little_endian, t.numeric, t.readable, list(h.shape), len(h.shape), h.size, min(h.size * t.itemsize, max(h.file_bytes - h.header_bytes, 0)), h.fortran, h.version, h.header_bytes, h.file_bytes, fields, t.unit, h.available < h.size, reason)


def numeric_view(a: np.ndarray, kind: str) -> np.ndarray:
    """Doubles: magnitude of complex numbers, ticks of dates (the marker is NaN), 0 and 1 of booleans."""
    if kind == "complex":
        return np.abs(a).astype(float)
    if kind in ("datetime", "timedelta"):
        ticks = a.view(a.dtype.str.replace("M8", "i8").replace("m8", "i8").split("[")[0]).astype(np.int64)
        return np.where(ticks == np.iinfo(np.int64).min, np.nan, ticks.astype(float))
    return a.astype(float)


def exact_text(a: np.ndarray, dtype: DType) -> list[str]:
    """Text of scalars: 64-bit integers keep all digits, complex numbers end in j, byte strings are Latin-1."""
    k = dtype.kind
    if k == "bool":
        return ["True" if x else "False" for x in a.tolist()]
    if k in ("int", "uint"):
        return pa.array(a.astype(a.dtype.newbyteorder("="))).cast(pa.string()).to_pylist()
    if k == "float":
        return [plain_number(x) for x in a.astype(float).tolist()]
    if k == "complex":
        return [f"{plain_number(x.real)}{'-' if np.signbit(x.imag) else '+'}{plain_number(abs(x.imag))}j" for x in a.astype(complex).tolist()]
    if k in ("datetime", "timedelta"):
        ticks = a.view("i8" if dtype.little_endian else ">i8").tolist()
        if k == "timedelta":
            return ["NaT" if x == np.iinfo(np.int64).min else f"{x} {dtype.unit}" if dtype.unit else str(x) for x in ticks]
        return [_date(x, dtype.unit) for x in ticks]
    if k == "bytes":
        return [x.rstrip(b"\0").decode("latin-1") for x in a.tolist()]
    if k == "str":
        return [x.split("\0")[0] for x in a.tolist()]
    return ["<object>" if k == "object" else bytes(x).hex() for x in a.tolist()]


def _date(ticks: int, unit: str | None) -> str:
    from datetime import datetime, timedelta

    from ..functions.dtype import MAX_DATE_MS, NAT, UNIT_MS

    if ticks == NAT:
        return "NaT"
    if unit not in UNIT_MS or abs(ticks * UNIT_MS[unit]) > MAX_DATE_MS:
        return str(ticks)
    try:
        t = datetime(1970, 1, 1) + timedelta(milliseconds=int(np.floor(ticks * UNIT_MS[unit])))
    except OverflowError:
        return str(ticks)
    return t.strftime("%Y-%m-%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}"


def plain_number(x: float) -> str:
    """Python version of :func:`lattica.functions.text.number`."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    if abs(x) < 1e-4 or abs(x) >= 1e9:
        m, _, e = f"{x:.4e}".partition("e")
        return f"{m}e{e[0]}{e[1:].lstrip('0') or '0'}"
    return np.format_float_positional(float(f"{x:.6e}"), trim="-")


def strides_of(shape: tuple[int, ...], fortran: bool) -> list[int]:
    """Elements between neighbours along each axis."""
    out, n = [0] * len(shape), 1
    for a in range(len(shape)) if fortran else reversed(range(len(shape))):
        out[a] = n
        n *= max(shape[a], 1)
    return out


def logical_positions(at: np.ndarray, h: Header) -> np.ndarray:
    """C-order positions of the elements at these places in the file."""
    if not h.fortran or len(h.shape) < 2:
        return at
    out, rest = np.zeros(at.size, np.int64), at
    for d, s in zip(h.shape, strides_of(h.shape, False), strict=True):
        out += rest % d * s
        rest = rest // d
    return out


def parse_window(text: str, shape: tuple[int, ...]) -> list[range]:
    """The selected indexes of each axis from slices and numbers; axes that are not named are whole."""
    parts = [p.strip() for p in text.split(",")] if text.strip() else []
    if len(parts) > len(shape):
        raise NpyError(f"the window has {len(parts)} axes, the array {len(shape)}")
    out = []
    for a, extent in enumerate(shape):
        bounds = parts[a].split(":") if a < len(parts) else [""]
        try:
            numbers = [int(b) if b.strip() else None for b in bounds]
        except ValueError as e:
            raise NpyError(f"not a window: {text}") from e
        if len(numbers) > 3 or (len(numbers) == 3 and (numbers[2] or 1) < 1):
            raise NpyError(f"not a window: {text}")
        one = len(numbers) == 1 and numbers[0] is not None
        out.append(range(*slice(numbers[0], numbers[0] + 1 or None).indices(extent)) if one else range(*slice(*numbers).indices(extent)) if len(numbers) > 1 else range(extent))
    return out


class Selection:
    """The elements of a window in the order in which they lie in the file, numbered from 0."""

    def __init__(self, h: Header, window: list[range]):
        order = list(reversed(range(len(window)))) if h.fortran else list(range(len(window)))
        stride = strides_of(h.shape, h.fortran)
        self.axes = [(window[a], stride[a]) for a in order]
        self.size = 1
        for r, _ in self.axes:
            self.size *= len(r)

    def places(self, first: int, count: int) -> np.ndarray:
        """Places in the file of the elements ``first`` .. ``first + count - 1``; ascending."""
        rest, out = np.arange(first, first + count, dtype=np.int64), np.zeros(count, np.int64)
        for r, stride in reversed(self.axes):
            out += (rest % len(r) * r.step + r.start) * stride
            rest //= len(r)
        return out

    def before(self, place: int) -> int:
        """How many of the elements lie before a place in the file."""
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if int(self.places(mid, 1)[0]) < place else (lo, mid)
        return lo


@dataclass
class _Range(InputPartition):
    path: str
    header: Header | None
    start: int
    count: int
    problem: str | None = None


@dataclass
class _Pack(InputPartition):
    """Byte ranges of files whose headers are not known yet: (path, first byte, end, bytes of the file); an end of None is that of the array."""

    pieces: list[tuple[str, int, int | None, int]]


def _packed(pieces: list[tuple[str, int, int | None, int]], most: int) -> list[_Pack]:
    """Pieces together until they have about ``most`` bytes, counting what opening costs.

    The more pieces there are, the more of them share a partition whatever
    ``most`` says, as a task costs more than some hundred small files; but not
    more than PARTITION_BYTES of their data.
    """
    least, full = min(HEADERS, -(-len(pieces) // FEW_FILES)), max(most, PARTITION_BYTES)
    out, room, data = [], 0, 0
    for p in pieces:
        size = (p[3] if p[2] is None else p[2]) - p[1]
        if not out or data + size > full or (size + OPEN_BYTES > room and len(out[-1].pieces) >= least):
            out.append(_Pack([]))
            room, data = most, 0
        out[-1].pieces.append(p)
        room, data = room - size - OPEN_BYTES, data + size
    return out


def located(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Files:
    """Ranged reads through pyarrow's file systems; bytes that are not local come through Hadoop's when libhdfs is there."""

    @staticmethod
    def open(path: str):
        system, inner = located(path)
        return system.open_input_file(inner)

    @staticmethod
    def list(path: str) -> list[tuple[str, int]]:
        """Path and bytes of each array file at or below ``path``; nothing is opened."""
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            return sorted((prefix + f.path, f.size) for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(".npy") and f.is_file)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return [(prefix + inner, info.size)]


def create(path: str, data: bytes) -> None:
    """Writes a small file through pyarrow's file systems, with the folders above it."""
    system, inner = located(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(data)


def read_header(path: str) -> Header:
    with _Files.open(path) as f:
        n = f.size()
        head = f.read(12)
        if head[:6] == MAGIC and len(head) == 12:
            length = struct.unpack("<H", head[8:10])[0] if head[6] == 1 else struct.unpack("<I", head[8:12])[0]
            head += f.read(min(length, MAX_HEADER) + 2)
        return parse_header(head, n)


def _columns(options) -> list[str]:
    """Columns of an element that are made: those of option ``columns``, or all but ``exact`` unless that is asked for."""
    exact = options.get("exact", "false").lower() == "true"
    out = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else [c for c in COLUMNS if c != "exact" or exact]
    if not out or set(out) - set(COLUMNS):
        raise NpyError(f"columns are some of {', '.join(COLUMNS)}")
    return out


def _problem(path: str, why: str, file_bytes: int | None) -> tuple:
    return (path, *[None] * 14, file_bytes, None, None, None, why)


class _Scan:
    """What both readers share: options, filters, and reading a range of a file."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.mode = schema, options.get("mode", "elements")
        self.paths = [p for p in (options.get("path") or "").split(",") if p]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.window, self.columns = options.get("window"), _columns(options)
        self.skip = options.get("problems", "raise") == "skip"
        #: Bounds of ``pos`` (both included) and its listed values; tests that a path must pass.
        self.low, self.high, self.among = 0, None, None
        self.tests: list = []

    def _files(self) -> list[tuple[str, int]]:
        return [(p, n) for own in self.paths for p, n in _Files.list(own) if all(t(p) for t in self.tests)]

    def _checked(self, path: str, h: Header) -> Header:
        if not (h.dtype.readable and (self.mode == "records" or not h.dtype.fields)):
            raise NpyError(f"{h.dtype.name} arrays are not read" + " as elements; use mode records" * bool(h.dtype.fields))
        return h

    def _numbers(self, h: Header, begin: int = 0, end: int | None = None) -> tuple[int, int]:
        """The selected elements (by their number in file order) that begin in a byte range and may pass the filters."""
        size = max(h.dtype.itemsize, 1)
        first = -(-max(begin - h.header_bytes, 0) // size)
        last = None if end is None else -(-max(end - h.header_bytes, 0) // size)
        if not h.fortran or len(h.shape) < 2:
            # positions are places
            first = max(first, self.low)
            last = last if self.high is None else min(self.high + 1, self.high + 1 if last is None else last)
        if self.window is None:
            return min(first, h.available), h.available if last is None else max(min(last, h.available), min(first, h.available))
        own = Selection(h, parse_window(self.window, h.shape))
        a = own.before(first)
        return a, own.size if last is None else max(a, own.before(last))

    def _passing(self, at: np.ndarray, h: Header) -> np.ndarray:
        """The places whose positions pass the filters."""
        if self.among is None and (not h.fortran or len(h.shape) < 2):
            return at
        pos = logical_positions(at, h)
        ok = pos >= self.low
        if self.high is not None:
            ok &= pos <= self.high
        if self.among is not None:
            ok &= np.isin(pos, self.among)
        return at[ok]

    def _range(self, path: str, h: Header, start: int, count: int):
        step = max(1, BATCH_BYTES // max(h.dtype.itemsize, 1))
        selection = Selection(h, parse_window(self.window, h.shape)) if self.window is not None else None
        with _Files.open(path) as f:
            for s in range(start, start + count, step):
                n = min(step, start + count - s)
                at = self._passing(selection.places(s, n) if selection else np.arange(s, s + n, dtype=np.int64), h)
                held = int(np.searchsorted(at, h.available))
                a = _gather(f, h, at[:held])
                yield self._records(path, at[:held], a, h) if self.mode == "records" else elements(path, at, a, h, self.columns)

    def _pack(self, part: _Pack):
        for path, begin, end, size in part.pieces:
            try:
                h = read_header(path)
                if self.mode == "meta":
                    yield _header_row(path, h)
                    continue
                self._checked(path, h)
            except NpyError as e:
                if self.mode == "meta":
                    yield _problem(path, str(e), size)
                elif not self.skip:
                    raise NpyError(f"{path}: {e}") from e
                continue
            a, b = self._numbers(h, begin, end)
            yield from self._range(path, h, a, b - a)

    def _records(self, path: str, at: np.ndarray, a: np.ndarray, h: Header) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        cols = [pa.repeat(path, len(a)), pa.array(logical_positions(at, h))]
        for f in h.dtype.fields:
            x, kind = a[f.name], f.dtype.spark()
            flat = [_cell(v, f.dtype) for v in x.reshape(len(a), -1).ravel()]
            if f.shape:
                flat = [flat[i * f.count : (i + 1) * f.count] for i in range(len(a))]
                kind = T.ArrayType(kind)
            cols.append(pa.array(flat, to_arrow_type(kind)))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema.fields])


class NpyReader(_Scan, DataSourceReader):
    def partitions(self):
        files = self._files()
        if self.mode == "meta":
            each = min(HEADERS, -(-len(files) // FEW_FILES)) or 1
            return [_Pack([(p, 0, None, n) for p, n in files[i : i + each]]) for i in range(0, len(files), each)] or [_Pack([])]
        if len(files) > FEW_FILES:
            cuts = lambda n: [*range(0, max(n, 1), self.bytes), None]
            return _packed([(p, a, b, n) for p, n in files for a, b in zip(cuts(n)[:-1], cuts(n)[1:], strict=True)], self.bytes)
        out: list = []
        for path, _ in files:
            try:
                h = self._checked(path, read_header(path))
            except NpyError as e:
                if not self.skip:
                    raise NpyError(f"{path}: {e}") from e
                continue
            step = max(1, self.bytes // max(h.dtype.itemsize, 1))
            a, b = self._numbers(h)
            out += [_Range(path, h, s, min(step, b - s)) for s in range(a, b, step)]
        return out or [_Pack([])]

    def read(self, part):
        yield from self._pack(part) if isinstance(part, _Pack) else self._range(part.path, part.header, part.start, part.count)


class NpyFilteringReader(NpyReader):
    """The reader for sessions that push filters; those it takes are applied in full."""

    def pushFilters(self, filters):
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f) -> bool:
        if isinstance(f, IsNotNull):
            return f.attribute in (("pos",), ("path",)) and self.mode != "meta"
        value = getattr(f, "value", None)
        if getattr(f, "attribute", None) == ("path",):
            tests = {EqualTo: lambda p: p == value, In: lambda p: p in value, StringStartsWith: lambda p: p.startswith(value), StringEndsWith: lambda p: p.endswith(value)}
            if type(f) in tests and value is not None:
                self.tests.append(tests[type(f)])
                return True
            return False
        if getattr(f, "attribute", None) != ("pos",) or self.mode == "meta":
            return False
        if isinstance(f, In):
            own = np.array([v for v in value if v is not None], np.int64)
            self.among = own if self.among is None else np.intersect1d(own, self.among)
            self._between(int(own.min()) if own.size else 1, int(own.max()) if own.size else 0)
            return True
        bounds = {EqualTo: (value, value), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value - 1), LessThanOrEqual: (None, value)}.get(type(f)) if isinstance(value, int) else None
        if bounds is None:
            return False
        self._between(*bounds)
        return True

    def _between(self, low: int | None, high: int | None) -> None:
        self.low = self.low if low is None else max(self.low, low)
        self.high = self.high if high is None else high if self.high is None else min(self.high, high)


class NpyStreamReader(_Scan, DataSourceStreamReader):
    """Offsets are the bytes of each file that have been taken.

    A batch has the elements that became whole since the last one: those of new
    files, and of files that were short by their header and have grown.  A file
    that is rewritten or shrinks isn't taken again.  The offset lists all files
    of the folder, which bounds its use to some hundred thousand.
    """

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": dict(self._files())}

    def partitions(self, start: dict, end: dict):
        before = start["files"]
        grown = [(p, before.get(p, 0), n) for p, n in sorted(end["files"].items()) if n > before.get(p, 0)]
        pieces = []
        for p, a, n in grown:
            cuts = [*range(a, n, self.bytes), n]
            pieces += [(p, x, y, n) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return _packed(pieces, self.bytes) or [_Pack([])]

    def read(self, part: _Pack):
        for path, begin, end, _ in part.pieces:
            try:
                h = self._checked(path, read_header(path))
            except HeaderCutOff:
                continue
            except NpyError as e:
                if self.skip:
                    continue
                raise NpyError(f"{path}: {e}") from e
            # whole elements up to the last byte, less those that were whole before
            whole = lambda n: min(max(n - h.header_bytes, 0) // max(h.dtype.itemsize, 1), h.available)  # noqa: B023, E731
            yield from self._range(path, h, whole(begin), whole(end) - whole(begin))


def _gather(f, h: Header, at: np.ndarray) -> np.ndarray:
    """The elements at ascending places: close ones come with one read, others are sought."""
    size, kind = h.dtype.itemsize, np.dtype(h.dtype.numpy)
    if not at.size:
        return np.zeros(0, kind)
    far = np.diff(at) * size > GAP_BYTES + size
    spans = np.diff(at * size // SPAN_BYTES) > 0
    begins = np.concatenate([[0], np.flatnonzero(far | spans & (np.diff(at) > 1)) + 1, [at.size]])
    out = np.empty(at.size, kind)
    for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        first, n = int(at[i]), int(at[j - 1] - at[i]) + 1
        f.seek(h.header_bytes + first * size)
        out[i:j] = np.frombuffer(f.read(n * size), kind, n)[at[i:j] - first]
    return out


def elements(path: str, at: np.ndarray, a: np.ndarray, h: Header, columns: list[str]) -> pa.RecordBatch:
    """Rows for the places ``at``; those after the values in ``a`` are missing."""
    gone = at.size - len(a)

    def values() -> pa.Array:
        if not h.dtype.numeric:
            return pa.nulls(at.size, pa.float64())
        own = numeric_view(a, h.dtype.kind)
        return pa.array(np.concatenate([own, np.full(gone, np.nan)]) if gone else own, pa.float64(), from_pandas=False)

    make = {
        "path": lambda: pa.repeat(path, at.size),
        "pos": lambda: pa.array(logical_positions(at, h)),
        "value": values,
        "exact": lambda: pa.array(exact_text(a, h.dtype) + [MISSING] * gone, pa.string()),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)


def _cell(v, dtype: DType):
    k = dtype.kind
    if k == "bytes":
        return bytes(v).rstrip(b"\0").decode("latin-1")
    if k == "str":
        return str(v).split("\0")[0]
    if k == "complex":
        return {"re": float(v.real), "im": float(v.imag)}
    if k in ("datetime", "timedelta"):
        return int(v.astype(np.int64)) if hasattr(v, "astype") else int(v)
    if k == "uint" and dtype.itemsize == 8:
        from decimal import Decimal

        return Decimal(int(v))
    return v.item() if hasattr(v, "item") else bytes(v)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self):
        mode = self.options.get("mode", "elements")
        if mode == "meta":
            return META
        if mode == "elements":
            return ", ".join(f"{c} {COLUMNS[c]}" for c in _columns(self.options))
        h = read_header(_Files.list(self.options["path"].split(",")[0])[0][0])
        if not h.dtype.fields:
            raise NpyError("records are asked for, but the array has no fields")
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("pos", T.LongType()), *h.dtype.spark().fields])

    def reader(self, schema: T.StructType) -> NpyReader:
        kind = NpyFilteringReader if self.options.get("pushdown", "false").lower() == "true" else NpyReader
        return kind(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> NpyStreamReader:
        if self.options.get("mode", "elements") == "meta" or self.options.get("window"):
            raise NpyError("a stream has elements or records, without a window")
        return NpyStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, path: str, mode: str = "elements", partition_bytes: int = PARTITION_BYTES, exact: bool = False, window: str | None = None, problems: str = "raise", columns: list[str] | None = None) -> DataFrame:
    """Elements, records or metadata of one file or of all ``.npy`` files below a folder.

    ``exact`` adds the exact text of each element; ``columns`` are all that is
    made, as a scan of Python's sources is not told what is used.  ``window`` has a slice or
    number for each axis, as in ``"0:64, ::8, 3"``; bytes outside of it are not
    read, and its elements past the end of a truncated file are NaN, while a
    read of the whole array has the elements that are there.  Filters of
    ``pos`` and ``path`` are pushed to the files if the session's setting
    ``spark.sql.python.filterPushdown.enabled`` is on.  A file that
    cannot be read as asked raises, or is left out if ``problems`` is
    ``skip``; in mode ``meta`` it is a row with the reason in ``unsupported``.
    """
    register(spark)
    reader = spark.read.format("npy").option("mode", mode).option("partition_bytes", partition_bytes).option("exact", str(exact).lower()).option("problems", problems)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("pushdown", "true")
    for key, value in (("window", window), ("columns", ",".join(columns) if columns else None)):
        reader = reader if value is None else reader.option(key, value)
    return reader.load(path)


def stream_npy(spark: SparkSession, path: str, mode: str = "elements", exact: bool = False, problems: str = "raise", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The elements or records of arriving and growing files as a stream; a restart from its checkpoint takes each element once."""
    register(spark)
    return spark.readStream.format("npy").option("mode", mode).option("exact", str(exact).lower()).option("problems", problems).option("partition_bytes", partition_bytes).load(path)


def window_of(plane: Plane, frames: list[int], rows: range, cols: range) -> str:
    """The window of :func:`read_npy` that holds these frames, rows and columns of a plane view, all channels."""
    by_axis = {plane.row: rows, plane.col: cols}
    left = frames
    for a in reversed(plane.frame_axes):
        extent = max(plane.shape[a], 1)
        digits = {f % extent for f in left}
        left = sorted({f // extent for f in left})
        by_axis[a] = range(min(digits, default=0), max(digits, default=-1) + 1)
    if len(plane.shape) == 2 and plane.row == 0 and plane.shape[0] == 1 and plane.vector:
        return f"{cols.start}:{cols.stop}:{cols.step}"
    return ",".join(":" if a not in by_axis else f"{by_axis[a].start}:{by_axis[a].stop}:{by_axis[a].step}" for a in range(len(plane.shape)))


def read_file_block(spark: SparkSession, path: str, plane: Plane, frames: list[int] | None = None, max_side: int = 1600, max_elements: int = 2_000_000) -> DataFrame:
    """:func:`lattica.operators.slices.read_block` of a file, reading only the frames, rows and columns that it needs."""
    wanted = list(range(plane.frames)) if frames is None else frames
    rs, cs = block_steps(plane, len(wanted), max_side, max_elements)
    window = window_of(plane, wanted, range(0, plane.extent(plane.row), rs), range(0, plane.extent(plane.col), cs))
    return read_block(read_npy(spark, path, window=window), plane, frames, max_side, max_elements)


def read_file_window(spark: SparkSession, path: str, plane: Plane, frame: int = 0, row0: int = 0, col0: int = 0, rows: int = PAGE_ROWS, cols: int = PAGE_COLUMNS) -> DataFrame:
    """:func:`lattica.operators.slices.table_window` of a file, with exact text, reading only the cells of the window."""
    window = window_of(plane, [frame], range(row0, min(row0 + rows, plane.extent(plane.row))), range(col0, min(col0 + cols, plane.extent(plane.col))))
    return table_window(read_npy(spark, path, exact=True, window=window), plane, frame, row0, col0, rows, cols)


def read_npy_binary(spark: SparkSession, path: str, exact: bool = False, problems: str = "raise") -> DataFrame:
    """Elements of the arrays at ``path`` through Spark's binary reader: any store, files below 2 GB, one task a file.

    A file that is no readable array raises, or is left out if ``problems`` is ``skip``.
    """

    columns = _columns({"exact": str(exact)})

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(data.as_buffer())
                try:
                    h = parse_header(bytes(raw[: MAX_HEADER + 12]), len(raw))
                    if not h.dtype.readable or h.dtype.fields:
                        raise NpyError(f"{h.dtype.name} arrays are not read as elements")
                except NpyError as e:
                    if problems == "skip":
                        continue
                    raise NpyError(f"{name}: {e}") from e
                step = max(1, BATCH_BYTES // max(h.dtype.itemsize, 1))
                for s in range(0, h.available, step):
                    a = np.frombuffer(raw, np.dtype(h.dtype.numpy), min(step, h.available - s), h.header_bytes + s * h.dtype.itemsize)
                    yield elements(name, np.arange(s, s + len(a), dtype=np.int64), a, h, columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, EXACT if exact else ELEMENTS)


def elements_of(df: DataFrame, array_col: str, id_col: str) -> DataFrame:
    """A column of arrays as a matrix in element form: (row, col, value), pos by row order left to :func:`lattica.operators.slices.numbered`."""
    return df.select(F.col(id_col).alias("row"), F.posexplode(array_col).alias("col", "value")).withColumn("value", F.col("value").cast("double"))
