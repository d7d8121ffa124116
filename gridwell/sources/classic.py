"""Self-describing array files in the classic binary layout (versions 1, 2 and 5), and the profile levels in them.

A file is a header (dimensions, attributes, variables with their types and places) and big-endian values; variables along the record dimension
stand interleaved, a record after the other. Files come as rows of their bytes and are decoded where they are, one at a time; a file that can't be
decoded is a row that says why.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need the libraries only

# Fixed values of the layout: tags of lists, and types by number.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: What stands for a missing number where a profile file names no other.
FILL = 99999.0


@dataclass
class Variable:
    dimensions: tuple[str, ...]
    values: np.ndarray
    attributes: dict[str, object] = field(default_factory=dict)

    def numbers(self) -> np.ndarray:
        """The values as doubles, scaled as the attributes say; fill values are NaN."""
        own = self.values.astype(np.float64)
        for name in ("_FillValue", "missing_value"):
            if name in self.attributes:
                own[self.values == np.asarray(self.attributes[name]).ravel()[0]] = np.nan
        scale, offset = (float(np.asarray(self.attributes.get(n, d)).ravel()[0]) for n, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return own * scale + offset


class _Header:
    """Reads a header's parts in order."""

    def __init__(self, data: bytes) -> None:
        if data[:3] != b"CDF" or len(data) < 8 or data[3] not in (1, 2, 5):
            raise ValueError("not a classic array file")
        self.data, self.at, self.version = data, 4, data[3]
        self.count, self.place = ">Q" if self.version == 5 else ">I", ">I" if self.version == 1 else ">Q"

    def number(self, form: str) -> int:
        (n,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the header ends early")
        own = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return own

    def name(self) -> str:
        return self.take(self.number(self.count)).decode()

    def items(self, tag: int) -> range:
        found, n = self.number(">I"), self.number(self.count)
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"a list of kind {found} where {tag} belongs")
        return range(n)

    def attributes(self) -> dict[str, object]:
        out = {}
        for _ in self.items(ATTRIBUTE):
            name, kind = self.name(), np.dtype(TYPES[self.number(">I")])
            raw = self.take(self.number(self.count) * kind.itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind)
        return out


def decode(data: bytes, names: Sequence[str] | None = None) -> dict[str, Variable]:
    """The variables of a file, or those of names that it has."""
    head = _Header(data)
    records = head.number(head.count)
    sizes = [(head.name(), head.number(head.count)) for _ in head.items(DIMENSION)]
    head.attributes()
    found = []
    for _ in head.items(VARIABLE):
        name = head.name()
        along = [head.number(head.count) for _ in range(head.number(head.count))]
        attributes, kind = head.attributes(), np.dtype(TYPES[head.number(">I")])
        head.number(head.count)  # the size, which follows from what is known
        found.append((name, along, attributes, kind, head.number(head.place)))

    def bytes_of(along: list[int], kind: np.dtype) -> int:
        return int(np.prod([sizes[d][1] or 1 for d in along], dtype=np.int64)) * kind.itemsize

    recorded = [v for v in found if v[1] and sizes[v[1][0]][1] == 0]
    padded = [-(-bytes_of(v[1], v[3]) // 4) * 4 for v in recorded]
    stride = bytes_of(recorded[0][1], recorded[0][3]) if len(recorded) == 1 else sum(padded)
    if recorded and records == (1 << 8 * struct.calcsize(head.count)) - 1:  # a file that was being written: as many as there are
        records = max(0, (len(data) - min(v[4] for v in recorded)) // stride)
    out = {}
    for name, along, attributes, kind, begin in found:
        if names is not None and name not in names:
            continue
        shape = [sizes[d][1] for d in along]
        if along and shape[0] == 0:
            shape[0] = records
            one = bytes_of(along, kind)
            if records and begin + (records - 1) * stride + one > len(data):
                raise ValueError(f"{name} ends early")
            values = np.ndarray(shape, kind, data, begin, (stride, *np.ndarray(shape[1:], kind).strides)) if records else np.zeros(shape, kind)
        else:
            if begin + bytes_of(along, kind) > len(data) and 0 not in shape:
                raise ValueError(f"{name} ends early")
            values = np.ndarray(shape, kind, data, begin)
        out[name] = Variable(tuple(sizes[d][0] for d in along), values, attributes)
    return out


def encode(dimensions: Mapping[str, int], variables: Mapping[str, Variable], version: int = 2, record: str | None = None) -> bytes:
    """A file of variables; record: the dimension that records are along, which has its length from them."""
    counts, place = (">Q" if version == 5 else ">I"), (">I" if version == 1 else ">Q")
    kinds = {np.dtype(t): k for k, t in TYPES.items()}
    order = list(dimensions)

    def pad(raw: bytes) -> bytes:
        return raw + b"\0" * (-len(raw) % 4)

    def text(name: str) -> bytes:
        return struct.pack(counts, len(name.encode())) + pad(name.encode())

    def listed(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">I", tag if parts else 0) + struct.pack(counts, len(parts)) + b"".join(parts)

    def attribute(name: str, value: object) -> bytes:
        own = np.frombuffer(value.encode(), "S1") if isinstance(value, str) else np.atleast_1d(np.asarray(value))
        own = own if own.dtype.kind == "S" else own.astype(own.dtype.newbyteorder(">"))
        return text(name) + struct.pack(">I", kinds[own.dtype]) + struct.pack(counts, own.size) + pad(own.tobytes())

    plain = {k: v.values if v.values.dtype.kind == "S" else v.values.astype(v.values.dtype.newbyteorder(">")) for k, v in variables.items()}
    recorded = [k for k, v in variables.items() if record and v.dimensions[:1] == (record,)]
    records = max((len(plain[k]) for k in recorded), default=0)
    sizes = {k: -(-(v[:1].nbytes if k in recorded and len(v) else v.nbytes) // 4) * 4 for k, v in plain.items()}

    def header(begins: Mapping[str, int]) -> bytes:
        own = [text(d) + struct.pack(counts, 0 if d == record else dimensions[d]) for d in order]
        parts = []
        for k, v in variables.items():
            along = struct.pack(counts, len(v.dimensions)) + b"".join(struct.pack(counts, order.index(d)) for d in v.dimensions)
            notes = listed(ATTRIBUTE, [attribute(*a) for a in v.attributes.items()])
            parts.append(text(k) + along + notes + struct.pack(">I", kinds[plain[k].dtype]) + struct.pack(counts, sizes[k]) + struct.pack(place, begins[k]))
        return b"CDF" + bytes([version]) + struct.pack(counts, records) + listed(DIMENSION, own) + listed(ATTRIBUTE, []) + listed(VARIABLE, parts)

    at, begins = len(header(dict.fromkeys(variables, 0))), {}
    for k in [*(k for k in plain if k not in recorded), *recorded]:
        begins[k] = at
        at += sizes[k]
    body = b"".join(pad(plain[k].tobytes()) for k in plain if k not in recorded)
    alone = len(recorded) == 1
    body += b"".join(plain[k][i : i + 1].tobytes() if alone else pad(plain[k][i : i + 1].tobytes()) for i in range(records) for k in recorded)
    return header(begins) + body


# The names of a profile file's variables, by what they are called here.
NUMBERS = {"lat": "LATITUDE", "lon": "LONGITUDE", "juld": "JULD", "cycle": "CYCLE_NUMBER", "pres": "PRES", "temp": "TEMP", "pres_adj": "PRES_ADJUSTED", "temp_adj": "TEMP_ADJUSTED"}
SIGNS = {
    "position_qc": "POSITION_QC", "juld_qc": "JULD_QC", "platform": "PLATFORM_NUMBER", "data_mode": "DATA_MODE", "pres_qc": "PRES_QC", "temp_qc": "TEMP_QC",
    "pres_adj_qc": "PRES_ADJUSTED_QC", "temp_adj_qc": "TEMP_ADJUSTED_QC",
}
BY_LEVEL = ("pres", "temp", "pres_adj", "temp_adj", "pres_qc", "temp_qc", "pres_adj_qc", "temp_adj_qc")
LEVELS = ", ".join([f"{c} {'int' if c == 'cycle' else 'double'}" for c in NUMBERS] + [f"{c} string" for c in SIGNS])


def levels_in(data: bytes) -> Iterator[tuple]:
    """The levels of a profile file, in the order of LEVELS. Missing flags pass, a missing flag of adjusted values is the raw one, missing modes are R, cycles -1."""
    own = decode(data, [*NUMBERS.values(), *SIGNS.values()])
    if missing := [n for n in ("LATITUDE", "LONGITUDE", "JULD", "PRES", "TEMP") if n not in own]:
        raise ValueError(f"no {', '.join(missing)}")
    profiles, levels = own["TEMP"].values.shape

    def whole(name: str) -> np.ndarray | None:
        if name in NUMBERS:
            return own[NUMBERS[name]].numbers() if NUMBERS[name] in own else None
        if SIGNS[name] not in own:
            return None
        signs = own[SIGNS[name]].values
        return np.array([b"".join(row.tolist()).decode("utf-8", "replace") for row in signs]) if name == "platform" else np.char.decode(signs, "latin-1")

    columns = {c: whole(c) for c in (*NUMBERS, *SIGNS)}
    default = {"cycle": -1, "data_mode": "R", "platform": "", "position_qc": "1", "juld_qc": "1", "pres_qc": "1", "temp_qc": "1"}
    for name in ("pres", "temp"):
        if columns[f"{name}_adj_qc"] is None:
            columns[f"{name}_adj_qc"] = columns[f"{name}_qc"]
    default |= {"pres_adj_qc": "1", "temp_adj_qc": "1"}
    for i in range(profiles):
        for k in range(levels):
            row = []
            for name, held in columns.items():
                v = default.get(name) if held is None else held[i, k] if name in BY_LEVEL else held[i]
                if v is None or (name in NUMBERS and v != v):
                    v = None
                row.append(v if v is None or held is None else int(v) if name == "cycle" else float(v) if name in NUMBERS else str(v))
            yield tuple(row)


class LevelsOfFile:
    """The table function: a file's levels with an empty error, or one row of nulls with the error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            rows = list(levels_in(bytes(content)))
        except Exception as e:  # what is wrong with a file is a row, not an end
            yield (*[None] * (len(NUMBERS) + len(SIGNS)), f"{type(e).__name__}: {e}")
            return
        for row in rows:
            yield (*row, "")


def read_levels(files: DataFrame) -> DataFrame:
    """files (path, content; others are ignored) to path, error and the columns of LEVELS, a row for each level of each file, and one for each file that can't be decoded.

    A null or empty content is such a file. Files are decoded one at a time; no files, no rows.
    """
    function = F.udtf(LevelsOfFile, returnType=f"{LEVELS}, error string")
    held = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    return held.lateralJoin(function(F.col("content").outer())).drop("content")


def read_profile_files(spark: SparkSession, pattern: str) -> DataFrame:
    """read_levels of the files that pattern names."""
    return read_levels(spark.read.format("binaryFile").load(pattern))


def profile_file(rows) -> bytes:
    """A profile file of rows (pandas, with the columns of LEVELS and profile and level, whole numbers from 0); levels that lack are fill values."""
    rows = rows.sort_values(["profile", "level"])
    n, m = int(rows["profile"].max()) + 1, int(rows["level"].max()) + 1
    first = rows.drop_duplicates("profile")
    at = rows["profile"].to_numpy(), rows["level"].to_numpy()
    longest = max(1, int(first["platform"].fillna("").str.len().max()))
    out = {}
    for c, name in NUMBERS.items():
        own, place, shape = (rows, at, (n, m)) if c in BY_LEVEL else (first, (first["profile"].to_numpy(),), (n,))
        values = np.full(shape, FILL)
        values[place] = own[c].astype(float).fillna(FILL).to_numpy()
        out[name] = Variable(("N_PROF", "N_LEVELS")[: len(shape)], values.astype(np.int32) if c == "cycle" else values, {"_FillValue": np.int32(FILL) if c == "cycle" else FILL})
    for c, name in SIGNS.items():
        own, place, shape = (rows, at, (n, m)) if c in BY_LEVEL else (first, (first["profile"].to_numpy(),), (n,))
        if c == "platform":
            values = np.full((n, longest), b" ", "S1")
            for i, text in zip(first["profile"], first[c].fillna(""), strict=True):
                values[i, : len(text)] = list(text)
            out[name] = Variable(("N_PROF", "STRING"), values)
        else:
            values = np.full(shape, b" ", "S1")
            values[place] = own[c].fillna(" ").to_numpy().astype("S1")
            out[name] = Variable(("N_PROF", "N_LEVELS")[: len(shape)], values)
    return encode({"N_PROF": n, "N_LEVELS": m, "STRING": longest}, out)
