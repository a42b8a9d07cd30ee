"""Operator 10: n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each distinct set of word n-grams (copies share one) and a column for each n-gram.

1. *Columns.* Entries are dealt by n-gram. A column with one entry adds nothing to the product off its diagonal and goes;
   the others get their length, so that rare columns can come first. A column that has as many entries in one gathering as a
   slice's fair share of it is hot: its entries go to the slices of their rows at once and only its name to its own slice,
   which then calls its entries from elsewhere hot too. Hot columns come last, by name.
2. *Rows.* A row that keeps fewer entries than ``threshold`` times its size can't reach the threshold with any other, and
   goes. The rest get a prefix of their rarest columns: two rows that link share a column within both prefixes.
3. *Candidate groups.* Rows are connected through their prefixes' columns (each row with the column's least row, never
   pair by pair), so that all rows that may link are in one group, and each row in one only. A task connects its own rows
   first and sends one row for each column, however many it has.
4. *Product.* Groups are cut into blocks of about ``BLOCK`` rows. A task accumulates the overlap counts of one row with
   the others from the columns' lists, or from the others' own entries where that is less; it discards pairs whose sizes
   exclude the threshold, and returns which classes its links join, never the pairs. Two rows that are joined already need
   no product. The first pass has one task for each block, which also gets the group's ``PIVOTS``: rows that all its
   blocks have in common, so near copies in different blocks become one class. For groups of several blocks, a second
   pass has the pairs of blocks that are left: blocks are cut anew from rows of one large class, or of small ones, and of
   one band of sizes. Two blocks of the same class, or of bands that are not neighbours, don't meet.
5. *Classes.* Connected components of those forests; each document gets the least doc_id of its component.

Sets are known by 64-bit hashes: among N different ones two agree with a chance of N * N / 2**65. N-grams are known by their
slice and 48 further bits: two texts of n n-grams each get one too many in common with a chance of n * n / 2**48 / slices.

A class of near copies
that holds a share of all rows costs a product of its rows with the others of its group, not with each other. Rows of one
group that don't link, but have rare n-grams and sizes alike, cost a product of their number's square, in parallel blocks.

Null texts and texts without words have an empty set and link with nothing. Rows with equal ids are judged by their own
text and get the component of their text; a null id counts for no component's least one, and a component of null ids alone
has null. Long texts are one row of the matrix, whatever their length. An empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import WordHashes, cuts, forget, frozen, mix, session, shuffle_partitions
from logweave.llm.components import components, forest

WORDS, THRESHOLD, BLOCK, PIVOTS = 5, 75, 2048, 8
#: Entries that a task gathers before it sends them; a column is hot if so many of them, and a slice's share of them, are its.
FLUSH, HOT = 750_000, 16
_HASHES = WordHashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(bodies: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of lower-cased words; of all its words where there are fewer."""
    split = [b.lower().split() for b in bodies]
    size = np.fromiter(map(len, split), np.int64, len(split))
    h = _HASHES.of([w for s in split for w in s])
    g = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        g = g * _STEP + h[k : k + len(g)]
    g = mix(g)
    out, at = [], 0
    for n in size.tolist():
        if n >= words:
            out.append(np.unique(g[at : at + n - words + 1]))
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[at : at + n]:
                    one = one * _STEP + x
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_key(grams: np.ndarray) -> int:
    """Names a set: the same for the same n-grams. As a signed number, as Spark has it."""
    total = np.add.reduce(mix(grams ^ _STEP)) + np.uint64(len(grams))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _members(words: int):
    def members(batches):
        for b in batches:
            sets = shingles(b["body"].to_pylist(), words)
            yield pa.record_batch([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "cls"])

    return members


_PACKED = pa.schema([("slice", pa.int32()), ("data", pa.binary())])
_ENTRIES = pa.schema([("slice", pa.int32()), ("data", pa.binary()), ("hot", pa.binary())])


def _pack(cls: np.ndarray, size: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows sorted by class, as runs: how many, then class, size and length of each run, then the columns."""
    at = cuts(cls)
    heads = at[:-1]
    return b"".join([len(heads).to_bytes(8, "little"), cls[heads].tobytes(), size[heads].astype(np.uint32).tobytes(), np.diff(at).astype(np.uint32).tobytes(), *(c.tobytes() for c in columns)])


def _unpack(data: bytes, *kinds) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(data[:8], "little")
    cls, size, run = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n), np.frombuffer(data, np.uint32, n, 8 + 12 * n)
    out, at, rows = [cls, size, run], 8 + 16 * n, int(run.sum())
    for kind in kinds:
        if kind == "six":
            whole = np.zeros((rows, 8), np.uint8)
            whole[:, :6] = np.frombuffer(data, np.uint8, 6 * rows, at).reshape(rows, 6)
            out.append(whole.view("<u8").ravel())
            at += 6 * rows
        else:
            out.append(np.frombuffer(data, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    return tuple(out)


def _by_slice(part: np.ndarray, cls: np.ndarray, size: np.ndarray, *columns: np.ndarray):
    """One packed row for each slice, its entries sorted by class."""
    order = np.lexsort((cls, part))
    part, cls, size, columns = part[order], cls[order], size[order], [c[order] for c in columns]
    at = cuts(part)
    rows = [(int(part[i]), _pack(cls[i:j], size[i:j], *(c[i:j] for c in columns))) for i, j in zip(at[:-1], at[1:], strict=True)] if len(part) else []
    for i in range(0, len(rows), 64):
        some = rows[i : i + 64]
        yield pa.record_batch([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.binary())], schema=_PACKED)


def slice_of(g: np.ndarray, slices: int) -> np.ndarray:
    """By the 16 upper bits, so that a slice and the lower 48 bits tell n-grams apart."""
    return ((g >> np.uint64(48)) * np.uint64(slices) >> np.uint64(16)).astype(np.int32)


def _six(g: np.ndarray) -> np.ndarray:
    """The lower 48 bits, as rows of 6 bytes."""
    return np.ascontiguousarray(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _named(g: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The slice and the lower 48 bits in one number."""
    return g & np.uint64((1 << 48) - 1) | (part % 65536).astype(np.uint64) << np.uint64(48)


def _row_slice(keys: np.ndarray, slices: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(slices)).astype(np.int32)


def hot(g: np.ndarray, slices: int, least: int) -> np.ndarray:
    """Which entries have an n-gram that makes up a slice's share of all of them."""
    least = max(least, len(g) // slices)
    out = np.zeros(len(g), bool)
    # few n-grams share their upper 20 bits with so many others
    bucket = (g >> np.uint64(44)).astype(np.int32)
    full = np.bincount(bucket, minlength=1 << 20) >= least
    if not full.any():
        return out
    some = np.flatnonzero(full[bucket])
    _, at, count = np.unique(g[some], return_inverse=True, return_counts=True)
    out[some] = count[at] >= least
    return out


def _entries(words: int, slices: int, least: int):
    def entries(batches):
        held: dict[int, np.ndarray] = {}
        n = 0

        def flush():
            if not held:
                return
            keys, sets = np.fromiter(held, np.int64, len(held)), list(held.values())
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            g = np.concatenate(sets)
            held.clear()
            keys, size, part = np.repeat(keys, size), np.repeat(size, size), slice_of(g, slices)
            over = hot(g, slices, least)
            if not over.any():
                for b in _by_slice(part, keys, size, _six(g)):
                    yield pa.record_batch([*b.columns, pa.array([b""] * len(b), pa.binary())], schema=_ENTRIES)
                return
            names = np.unique(g[over])
            of, six = slice_of(names, slices), _six(names)
            for b in _by_slice(part[~over], keys[~over], size[~over], _six(g[~over])):
                yield pa.record_batch([*b.columns, pa.array([six[of == p].tobytes() for p in b["slice"].to_pylist()], pa.binary())], schema=_ENTRIES)
                of = np.where(np.isin(of, b["slice"].to_numpy()), -1, of)
            for p in np.unique(of[of >= 0]).tolist():
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([_pack(keys[:0], size[:0])], pa.binary()), pa.array([six[of == p].tobytes()], pa.binary())], schema=_ENTRIES)
            for b in _by_slice(slices + _row_slice(keys[over], slices), keys[over], size[over], _named(g[over], part[over])):
                yield pa.record_batch([*b.columns, pa.array([None] * len(b), pa.binary())], schema=_ENTRIES)

        for b in batches:
            for s in shingles(b["body"].to_pylist(), words):
                if len(s) and (key := set_key(s)) not in held:
                    held[key] = s
                    n += len(s)
            if n >= FLUSH:
                yield from flush()
                n = 0
        yield from flush()

    return entries


_MANY = np.uint32(0xFFFFFFFF)


def _columns(slices: int):
    def columns(table: pa.Table) -> pa.Table:
        """Keeps the slice's columns that have two entries or more, and dealt by class sends them on with their length."""
        at = table["slice"][0].as_py()
        parts = [_unpack(d, "six" if at < slices else np.uint64) for d in table["data"].to_pylist()]
        keys = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        size = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
        g = np.concatenate([p[3] for p in parts])
        order = np.lexsort((keys, g))
        keys, size, g = keys[order], size[order], g[order]
        new = np.append(True, (g[1:] != g[:-1]) | (keys[1:] != keys[:-1])) if len(g) else np.zeros(0, bool)
        keys, size, g = keys[new], size[new], g[new]
        if at >= slices:
            df = np.full(len(g), _MANY)
        else:
            edge = cuts(g)
            df = np.repeat(np.diff(edge), np.diff(edge)).astype(np.uint32)
            said = b"".join(d for d in table["hot"].to_pylist() if d)
            if said:
                known = np.zeros((len(said) // 6, 8), np.uint8)
                known[:, :6] = np.frombuffer(said, np.uint8).reshape(-1, 6)
                df[np.isin(g, known.view("<u8").ravel())] = _MANY
            ok = df >= 2
            keys, size, df = keys[ok], size[ok], df[ok]
            g = _named(g[ok], np.full(len(keys), at))
        return pa.Table.from_batches(list(_by_slice(_row_slice(keys, slices), keys, size, g, df)), _PACKED)

    return columns


def least_overlap(size, threshold: int):
    """The least number of common n-grams that a set of this size needs to link with any other."""
    return -(-threshold * size // 100)


_ROWS = pa.schema([("cls", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _rows(threshold: int):
    def rows(table: pa.Table) -> pa.Table:
        parts = [_unpack(d, np.uint64, np.uint32) for d in table["data"].to_pylist()]
        keys = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        size = np.concatenate([np.repeat(p[1], p[2]) for p in parts]).astype(np.int64)
        g = np.concatenate([p[3] for p in parts])
        df = np.concatenate([p[4] for p in parts])
        # a column that was hot for one task only comes with the same row from another as well
        order = np.lexsort((g, keys))
        keys, size, g, df = keys[order], size[order], g[order], df[order]
        new = np.append(True, (g[1:] != g[:-1]) | (keys[1:] != keys[:-1])) if len(g) else np.zeros(0, bool)
        keys, size, g, df = keys[new], size[new], g[new], df[new]
        order = np.arange(len(keys))
        at = cuts(keys[order])
        kept = np.diff(at)
        need = least_overlap(size[order[at[:-1]]], threshold) if len(order) else kept
        out: dict[str, list] = {f.name: [] for f in _ROWS}
        for k in np.flatnonzero(kept >= need).tolist():
            own = order[at[k] : at[k + 1]]
            n = int(size[own[0]])
            own = own[np.lexsort((g[own], df[own]))]
            prefix = own[: len(own) - int(need[k]) + 1]
            out["cls"].append(int(keys[own[0]]))
            out["size"].append(n)
            out["grams"].append(np.sort(g[own]).tobytes())
            out["prefix"].append(g[prefix].view(np.int64))
        return pa.table([pa.array(out[f.name], f.type) for f in _ROWS], schema=_ROWS)

    return rows


_STARS = pa.schema([("slice", pa.int32()), ("grams", pa.binary()), ("rows", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])


def _starred(gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns with their least row, and for each entry that row."""
    order = np.lexsort((row, gram))
    gram, row = gram[order], row[order]
    at = cuts(gram)
    star = row[at[:-1]]
    back = np.empty(len(row), np.int64)
    back[order] = np.repeat(star, np.diff(at))
    return gram[at[:-1]], star, back


def _stars(slices: int):
    def stars(batches):
        held, n, turn = [], 0, 0

        def flush():
            gram, row = np.concatenate([g for g, _ in held]), np.concatenate([r for _, r in held])
            names, star, back = _starred(gram, row)
            hi, lo = forest(row, back)
            part = (names.view(np.uint64) % np.uint64(slices)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            names, star, part = names[order], star[order], part[order]
            at = cuts(part)
            own = turn % max(len(at) - 1, 1)
            for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                yield pa.record_batch([pa.array([part[i]], pa.int32()), *(pa.array([x], pa.binary()) for x in (names[i:j].tobytes(), star[i:j].tobytes(), hi.tobytes() if k == own else b"", lo.tobytes() if k == own else b""))], schema=_STARS)

        for b in batches:
            prefix = b["prefix"]
            gram = np.asarray(prefix.flatten().to_numpy(zero_copy_only=False), np.int64)
            row = np.repeat(b["cls"].to_numpy(), np.diff(prefix.offsets.to_numpy()))
            if len(gram):
                held.append((gram, row))
                n += len(gram)
            if n >= FLUSH:
                yield from flush()
                turn += 1
                held, n = [], 0
        if held:
            yield from flush()

    return stars


def _connected(table: pa.Table) -> pa.Table:
    gram, row, hi, lo = (np.concatenate([np.frombuffer(d, np.int64) for d in table[c].to_pylist()]) for c in ("grams", "rows", "hi", "lo"))
    _, _, back = _starred(gram, row)
    hi, lo = forest(np.concatenate((hi, row)), np.concatenate((lo, back)))
    return pa.table([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["cls", "star"])


_EDGES = "a long, b long"


def _product(threshold: int):
    def product(table: pa.Table) -> pa.Table:
        """(a, b) for each two classes that a link joins; with ``cross``, by pairs of rows of different sides only."""
        size = np.asarray(table["size"].to_numpy(), np.int64)
        order = np.lexsort((table["cls"].to_numpy(), size))
        size, side = size[order], np.asarray(table["side"].to_numpy(), np.int64)[order]
        names, label = np.unique(table["label"].to_numpy(), return_inverse=True)
        label, cross = label[order], table["cross"][0].as_py()
        grams = table["grams"].to_pylist()
        grams = [np.frombuffer(grams[i], np.uint64) for i in order.tolist()]
        n, length = len(grams), np.fromiter(map(len, grams), np.int64, len(grams))
        _, col = np.unique(np.concatenate(grams), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(length)))
        lists = np.repeat(np.arange(n), length)[np.argsort(col, kind="stable")]
        first = np.concatenate(([0], np.cumsum(np.bincount(col))))
        mark = np.zeros(len(first), np.int64)
        # sizes ascend, so the rows that may link with row k and come after it end at this place
        end = np.searchsorted(size, size * 100 // threshold, "right").tolist()
        a, b = [], []
        for k in range(n):
            apart = label[k + 1 : end[k]] != label[k]
            if cross:
                apart &= side[k + 1 : end[k]] != side[k]
            rest = np.flatnonzero(apart) + k + 1
            if not len(rest):
                continue
            own = col[begin[k] : begin[k + 1]]
            if length[rest].sum() < (first[own + 1] - first[own]).sum():
                mark[own] = 1
                theirs = mark[np.concatenate([col[begin[r] : begin[r + 1]] for r in rest.tolist()])]
                count = np.add.reduceat(theirs, np.cumsum(length[rest]) - length[rest])
                mark[own] = 0
            else:
                count = np.bincount(np.concatenate([lists[first[c] : first[c + 1]] for c in own.tolist()]), minlength=n)[rest]
            hit = 100 * count >= threshold * (size[k] + size[rest] - count)
            others = np.unique(label[rest[hit]])
            if len(others):
                a += [int(names[label[k]])] * len(others)
                b += names[others].tolist()
                label[np.isin(label, others)] = label[k]
        hi, lo = forest(np.array(a, np.int64), np.array(b, np.int64))
        return pa.table([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["a", "b"])

    return product


def _first_pass(rows: DataFrame, groups: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Links within the blocks of each group, which have the group's pivots in common."""
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    placed = groups.join(sizes.hint("merge"), "root").select("node", "root", F.when(F.array_contains("pivots", F.col("node")), everywhere).otherwise(own).alias("at"))
    dealt = rows.join(placed.hint("merge"), F.col("cls") == F.col("node")).select(
        "root", F.explode("at").alias("block"), "cls", F.col("cls").alias("label"), "size", F.lit(0).alias("side"), F.lit(False).alias("cross"), "grams"
    )
    return dealt.groupBy("root", "block").applyInArrow(_product(threshold), _EDGES)


def _second_pass(rows: DataFrame, groups: DataFrame, sizes: DataFrame, linked: DataFrame, threshold: int) -> DataFrame:
    """Links between classes that the first pass has left apart, in groups of several blocks."""
    # a little wider than the bound of sizes that may link, so that rounding can't part two such sizes by more than a band
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / threshold * (1 + 1e-6)))).alias("band")
    members = groups.join(sizes.where("blocks > 1").select("root").hint("merge"), "root").select("node", F.col("root").alias("grp"))
    labels = linked.select("node", F.col("root").alias("label"))
    members = members.join(labels.hint("merge"), "node", "left").select("node", "grp", F.coalesce("label", "node").alias("label"))
    members = frozen(members.join(rows.select(F.col("cls").alias("node"), band).hint("merge"), "node"), "members")
    large = members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK).select("label", F.col("label").alias("pure"))
    unit = F.concat_ws(".", "grp", F.coalesce(F.col("pure").cast("string"), F.lit("mixed")), "band").alias("unit")
    members = members.join(large.hint("merge"), "label", "left").select("node", "grp", "label", "pure", "band", unit)
    units = frozen(members.groupBy("unit", "grp", "pure", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks")), "units")
    name = lambda slot: F.concat_ws(".", "unit", slot)
    blocks = units.select("grp", "pure", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("slot"), "unit").select("grp", "pure", "band", name("slot").alias("i"))
    above = blocks.select("grp", F.col("pure").alias("other"), F.col("band").alias("top"), F.col("band").alias("meet"), F.col("i").alias("j"))
    pairs = (
        blocks.withColumn("meet", F.explode(F.array("band", F.col("band") + 1)))
        .join(above.hint("merge"), ["grp", "meet"])
        .where("(band < top or i <= j) and not coalesce(pure = other, false)")
        .select("i", "j", (F.col("i") != F.col("j")).alias("cross"))
    )
    sides = pairs.select(F.col("i").alias("block"), F.lit(0).alias("side"), "i", "j", "cross").unionByName(pairs.where("cross").select(F.col("j").alias("block"), F.lit(1).alias("side"), "i", "j", "cross"))
    placed = members.join(units.select("unit", "blocks").hint("merge"), "unit").select("node", "label", name(F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    dealt = rows.join(placed.join(sides.hint("merge"), "block").hint("merge"), F.col("cls") == F.col("node")).select("i", "j", "cls", "label", "size", "side", "cross", "grams")
    return dealt.groupBy("i", "j").applyInArrow(_product(threshold), _EDGES)


def ngram_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; ``threshold`` is the least Jaccard similarity in percent."""
    spark = session(docs.sparkSession)
    slices = shuffle_partitions(spark)
    bodies = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    members = frozen(bodies.mapInArrow(_members(words), "doc_id long, n_shingles long, cls long"), "sets")
    packed = "slice int, data binary"
    entries = bodies.select("body").mapInArrow(_entries(words, slices, HOT), f"{packed}, hot binary")
    columns = entries.groupBy("slice").applyInArrow(_columns(slices), packed)
    rows = frozen(columns.groupBy("slice").applyInArrow(_rows(threshold), "cls long, size long, grams binary, prefix array<long>"), "rows")

    stars = rows.select("cls", "prefix").mapInArrow(_stars(slices), "slice int, grams binary, rows binary, hi binary, lo binary")
    groups = components(stars.groupBy("slice").applyInArrow(_connected, "cls long, star long"), "cls", "star", "groups")

    blocks = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))
    pivots = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64(F.lit(k), F.col("node"))) for k in range(PIVOTS))))
    sizes = frozen(groups.groupBy("root").agg(blocks.alias("blocks"), pivots.alias("pivots")), "sizes")
    entries_of = rows.select("cls", "size", "grams")
    linked = components(_first_pass(entries_of, groups, sizes, threshold), "a", "b", "links")
    if not sizes.where("blocks > 1").isEmpty():
        further = _second_pass(entries_of, groups, sizes, linked, threshold)
        linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(further), "a", "b", "links")
    linked = frozen(linked, "linked")
    forget(rows)

    least = members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(linked.hint("merge"), F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(of_root.hint("merge"), "root").select("cls", "component_id")
    return members.join(of_class.hint("merge"), "cls", "left").select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
