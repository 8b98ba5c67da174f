"""Address databases (.mmdb) as tables of intervals.

The search tree is cut into subtrees, one a task; a task walks its subtree with a few
pages of the file in memory and decodes a record when it meets it first.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clientlens.sources.ends import list_files, opened

# Fixed values of the format: the mark before the metadata, where to look for it, the gap after the tree.
MARK, MARK_WITHIN, GAP = b"\xab\xcd\xefMaxMind.com", 128 << 10, 16
PAGE, PAGES = 1 << 16, 256
#: Levels of the tree that the plan opens: at most 2**6 subtrees of either version.
PLANNED = 6
SCHEMA = "lo string, hi string, asn bigint, as_org string, country string, country_name string, suppressed boolean, record string"
# Traits that leave an address without one country; database types, best first.
NO_PLACE = ("is_anycast", "is_anonymous_proxy", "is_satellite_provider")
ASN_TYPES, COUNTRY_TYPES = ("asn", "isp", "enterprise"), ("country", "city", "enterprise")


class Paged:
    """Bytes of a file by place, a bounded number of pages at a time."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        self.size, self.pages = self.file.size(), OrderedDict()

    def __call__(self, at: int, n: int) -> bytes:
        first, last = at // PAGE, (at + n - 1) // PAGE
        out = b"".join(self._page(p) for p in range(first, last + 1))
        return out[at - first * PAGE : at - first * PAGE + n]

    def _page(self, p: int) -> bytes:
        if p not in self.pages:
            self.pages[p] = self.file.read_at(min(PAGE, max(0, self.size - p * PAGE)), p * PAGE)
            if len(self.pages) > PAGES:
                self.pages.popitem(last=False)
        self.pages.move_to_end(p)
        return self.pages[p]


class Database:
    def __init__(self, uri: str):
        self.read = Paged(uri)
        tail = min(MARK_WITHIN, self.read.size)
        end = self.read(self.read.size - tail, tail)
        if MARK not in end:
            raise ValueError(f"{uri} is no address database")
        self.data = self.read.size - tail + end.rindex(MARK) + len(MARK)  # pointers of the metadata count from here
        self.meta, _ = self.value(self.data)
        self.nodes, self.bits = self.meta["node_count"], self.meta["record_size"]
        self.tree = self.nodes * self.bits // 4
        self.data = self.tree + GAP
        self.records: dict[int, tuple] = {}

    def child(self, node: int, side: int) -> int:
        w = self.bits // 4
        raw = self.read(node * w, w)
        if self.bits == 28:
            high = raw[3] >> 4 if side == 0 else raw[3] & 15
            return high << 24 | int.from_bytes(raw[:3] if side == 0 else raw[4:], "big")
        return int.from_bytes(raw[: w // 2] if side == 0 else raw[w // 2 :], "big")

    def value(self, at: int):
        """(value, place after it) of the data at ``at``."""
        control = self.read(at, 1)[0]
        kind, at = control >> 5, at + 1
        if kind == 1:
            n = control >> 3 & 3
            raw = self.read(at, n + 1)
            base = (control & 7) << 8 * (n + 1) if n < 3 else 0
            to = (base | int.from_bytes(raw, "big")) + (0, 2048, 526336, 0)[n]
            return self.value(self.data + to)[0], at + n + 1
        if kind == 0:
            kind, at = self.read(at, 1)[0] + 7, at + 1
        size = control & 31
        if size > 28:
            n = size - 28
            size = (29, 285, 65821)[n - 1] + int.from_bytes(self.read(at, n), "big")
            at += n
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self.value(at)
                out[key], at = self.value(at)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self.value(at)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw = self.read(at, size) if size else b""
        if kind == 2:
            return raw.decode("utf-8", "replace"), at + size
        if kind == 3:
            return struct.unpack(">d", raw)[0], at + size
        if kind == 15:
            return struct.unpack(">f", raw)[0], at + size
        if kind == 4:
            return raw.hex(), at + size
        return int.from_bytes(raw.rjust(4, b"\0") if kind == 8 else raw, "big", signed=kind == 8), at + size

    def record(self, pointer: int) -> tuple:
        """Columns of the record that a leaf points to."""
        if pointer not in self.records:
            r, _ = self.value(self.tree + pointer - self.nodes)
            r = r if isinstance(r, dict) else {}
            whole = lambda v, kind: v if isinstance(v, kind) and v else None
            place = r.get("country") if isinstance(r.get("country"), dict) else {}
            names, traits = place.get("names"), r.get("traits")
            self.records[pointer] = (
                whole(r.get("autonomous_system_number"), int), whole(r.get("autonomous_system_organization"), str), whole(place.get("iso_code"), str),
                whole(names.get("en"), str) if isinstance(names, dict) else None, isinstance(traits, dict) and any(traits.get(t) for t in NO_PLACE), json.dumps(r, sort_keys=True),
            )
        return self.records[pointer]

    def v4_root(self) -> int | None:
        """The node of the addresses of version 4; None if they share a leaf."""
        node = 0
        for _ in range(96 if self.meta["ip_version"] == 6 else 0):
            if node >= self.nodes:
                return None
            node = self.child(node, 0)
        return node if node < self.nodes else None

    def subtrees(self, levels: int) -> list[tuple[int, int, int, bool]]:
        """(node, prefix, length, version 4) of the parts of the tree."""
        four, out = self.v4_root(), []
        roots = [(four, 0, 0, True)] if four is not None else []
        if self.meta["ip_version"] == 6:
            roots.append((0, 0, 0, False))
        for root in roots:
            level = [root]
            for _ in range(levels):
                level = [
                    (self.child(node, side), prefix << 1 | side, n + 1, v4) if node < self.nodes and (v4 or node != four) else (node, prefix, n, v4)
                    for node, prefix, n, v4 in level
                    for side in ((0, 1) if node < self.nodes and (v4 or node != four) else (0,))
                ]
            out += level
        return out

    def walk(self, node: int, prefix: int, length: int, v4: bool) -> Iterator[tuple[int, int, int]]:
        """(lo, hi, pointer) below a node, in order; what leads to the tree of version 4
        from elsewhere is left out."""
        width = 32 if v4 else 128
        four = None if v4 else self.v4_root()
        stack = [(node, prefix, length)]
        while stack:
            node, prefix, n = stack.pop()
            if node == self.nodes or (not v4 and node == four):
                continue
            if node > self.nodes:
                lo = prefix << (width - n)
                yield lo, lo + (1 << (width - n)) - 1, node
                continue
            stack.append((self.child(node, 1), prefix << 1 | 1, n + 1))
            stack.append((self.child(node, 0), prefix << 1, n + 1))


class Subtree(InputPartition):
    def __init__(self, uri: str, root: tuple):
        self.uri, self.root = uri, root


class MmdbReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]

    def partitions(self):
        return [Subtree(self.uri, r) for r in Database(self.uri).subtrees(PLANNED)] or [Subtree("", ())]

    def read(self, part: Subtree) -> Iterator[tuple]:
        if not part.uri:
            return
        db, v4 = Database(part.uri), part.root[3]
        key = (lambda n: f"{'0' * 20}ffff{n:08x}") if v4 else (lambda n: f"{n:032x}")
        held = None
        for lo, hi, pointer in db.walk(*part.root):
            # neighbours with one record are one interval
            if held and held[2] == pointer and held[1] + 1 == lo:
                held = (held[0], hi, pointer)
                continue
            if held:
                yield key(held[0]), key(held[1]), *db.record(held[2])
            held = (lo, hi, pointer)
        if held:
            yield key(held[0]), key(held[1]), *db.record(held[2])


class MmdbSource(DataSource):
    """``spark.read.format("mmdb").load(uri)``: an interval a row."""

    @classmethod
    def name(cls):
        return "mmdb"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MmdbReader(self.options)


def read_mmdb(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi, asn, as_org, country, country_name, suppressed, record) of a database."""
    spark.dataSource.register(MmdbSource)
    return spark.read.format("mmdb").load(list_files(spark, [path])[0][0])


def discover(spark: SparkSession, folder: str) -> dict[str, str]:
    """{"asn": file, "country": file}: the best database of a folder for each, by the
    type its metadata names; of equals the first by name."""
    best: dict[str, tuple[int, str]] = {}
    for uri, _ in list_files(spark, [folder]):
        if uri.endswith(".mmdb"):
            try:
                kind = str(Database(uri).meta.get("database_type", "")).lower()
            except (ValueError, OSError, LookupError):
                continue
            for role, kinds in (("asn", ASN_TYPES), ("country", COUNTRY_TYPES)):
                rank = next((k for k, name in enumerate(kinds) if name in kind), None)
                if rank is not None and (role not in best or rank < best[role][0]):
                    best[role] = (rank, uri)
    return {role: uri for role, (_, uri) in best.items()}
