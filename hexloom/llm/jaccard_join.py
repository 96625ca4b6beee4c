"""N-gram Jaccard join by parity sketches.

Each document is the set of its distinct word shingles. The tokens of a set flip bits of a sketch, so the Hamming
distance of two sketches is at most the size of the sets' symmetric difference. Sets that reach the threshold differ
in few tokens for their size, so if the sketch is dealt into more pieces than that, some piece is equal in both: an
equi-join on pieces (one set of pieces per size band) finds every pair. A pair's dense sketches must then keep to the
Hamming bound, and at last the sets themselves are compared.

Size bands. Band j holds the sets of up to ``BANDS[j]`` tokens that are too large for band j - 1, and as guests those
of band j + 1 which may still reach the threshold with one of its own. A band has more pieces than any of its pairs
may differ in; pieces that hold no token of a set say nothing and give no key. A set with so many empty pieces that
the pigeonhole argument could fail draws its pieces again with the next seed, and gives keys for every seed up to the
first that serves: the pair is met at the earlier of both sets' seeds. So no link is lost and no key is shared by all.

Scale. Equal sets are one node, named by 128 bits of the set, so copies of any number cost one key set per task. Keys
travel as packed blobs by bucket of the key; the number of buckets follows the input. Nodes with an equal key are a
run; runs are kept as (run, node) rows of ids, and all that follows is decided on these before a sketch is sent:

- the counting form of the pigeonhole argument says that a node shares at least ``need`` pieces with any partner: nodes
  that stand in fewer runs have none, which settles most that meet by chance;
- a node is first compared with one other, the most central node (that of the most and longest runs) of most of its
  runs, and links between these are contracted to components;
- only runs with nodes of different components are looked at again. Of a node's mixed runs the ``need - 1`` costliest are
  left out, so that pairs meet in the cheapest run that they share, and of runs with the same nodes one is looked at;
- what is left is compared by dense sketches, each node outside a run's largest component with those of other
  components, in cells of bounded size; the members of the largest component are sent once for each slice of the nodes
  outside. The nearest pairs are verified first; runs with more than those are looked at again, until none is left.

Copies are never expanded into pairs, and no pair is tried within a component.

Defined cases: a null or empty text has no shingles and links with nothing; a text with fewer words than a shingle is
one shingle; rows with a null id take part but name no component; rows that share an id and differ in text are
documents of their own; copies, ties and repeated rows fall into one component, named by the smallest id; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import Words, bytes_of, gathered, mix, pieces, scratch, size_of, written
from hexloom.operators.components import components

U = np.uint64
SHINGLE = 5
BANDS = [5]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, int(BANDS[-1] * 1.7)))
BANDS = np.array(BANDS, np.int64)
BLOCK, BLOCK_BYTES, NEAREST, FLUSH_KEYS, BUCKET_BYTES, SENT_ROWS = 8192, 32 << 20, 16, 1_000_000, 4 << 20, 500_000
SIG = "doc_id long, row long, node long, name binary, n long, band int, own binary, guest binary"
#: ``need`` travels in seven bits and is rounded down to one of these, which loses nothing.
NEEDS = np.concatenate([np.arange(64), (64 * 2 ** (np.arange(64) / 6)).astype(np.int64)])
SALT, TWIN = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the texts' offsets into them."""
    count = np.diff(w.offsets)
    of = w.text_of()
    h = np.zeros(len(w.hash), U)
    left = w.offsets[1:][of] - np.arange(len(of)) if len(of) else np.zeros(0, np.int64)
    for k in range(size):
        have = len(h) - k
        if have <= 0:
            break
        nxt = mix(h[:have] * SALT + w.hash[k:])
        h[:have] = np.where(left[:have] > k, nxt, h[:have])
    keep = left >= size
    firsts = w.offsets[:-1][(count > 0) & (count < size)]
    keep[firsts] = True
    h, of = h[keep], of[keep]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(of[order].astype(np.uint16 if w.texts < 65536 else np.int64), kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(w.texts + 1))


def nodes_of(h: np.ndarray, at: np.ndarray, salt: np.uint64 = SALT) -> np.ndarray:
    """A 64-bit name for each set (order-free); sets without tokens get 0."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(h + salt))])
    n = np.diff(at)
    name = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(U) * salt)
    name[name == 0] = U(1)
    name[n == 0] = 0
    return name


def names_of(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """A 128-bit name for each set, whose first half is the node."""
    both = np.stack([nodes_of(h, at), nodes_of(h, at, TWIN)], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def entries(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band entries of sets of the given sizes: set, band, pieces, and the most tokens that a partner there may differ in.

    A pair of sizes a, b reaches p percent only if it differs in at most (a + b) (100 - p) / (100 + p) tokens and the
    larger is at most 100 / p times the smaller.
    """
    least = np.flatnonzero(n > 0)
    size = n[least]
    band = np.searchsorted(BANDS, size)
    most = lambda a: a * 100 // percent
    apart = lambda a, b: (a + b) * (100 - percent) // (100 + percent)
    top = BANDS[band]
    widest = apart(top, most(top))
    below = np.where(band > 0, BANDS[np.maximum(band - 1, 0)], 0)
    guest = (band > 0) & (size <= most(below))
    set_of = np.concatenate([least, least[guest]])
    bands = np.concatenate([band, band[guest] - 1])
    wide_guest = apart(below, most(below))[guest]
    wide = np.concatenate([widest, wide_guest])
    differ = np.concatenate([apart(size, most(size)), apart(below, size)[guest]])
    keep = differ > 0
    return set_of[keep], bands[keep], (wide + 3 + wide // 25)[keep], differ[keep]


def keys_of(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of non-empty sketch pieces, the index of each one's set, and a byte for its entry: whether the set is a guest
    (the upper bit), and how many keys it shares at least with any partner in the band (as a place in ``NEEDS``).

    Partners differ in no more than ``differ`` pieces, and of the others no more than this set's empty ones give no key.
    That counts pieces of the first seed, so it holds for sets which that seed serves; others share one key.
    """
    n = np.diff(at)
    set_of, band, count, differ = entries(n, percent)
    keys, owners, marks = [], [], []
    seed = 0
    while len(set_of):
        size = n[set_of]
        tokens = mix(h[gathered(at[set_of], size)] ^ mix(np.full(1, seed + 1, U))[0])
        entry = np.repeat(np.arange(len(set_of)), size)
        base = np.concatenate([[0], np.cumsum(count)])
        piece = base[entry] + ((tokens >> U(32)) * count[entry].astype(U) >> U(32)).astype(np.int64)
        parity = np.zeros(base[-1], U)
        np.bitwise_xor.at(parity, piece, mix((tokens & U(0xFFFFFFFF)) + SALT))
        full = np.bincount(piece, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(set_of)), count)
        number = np.arange(base[-1]) - base[owner]
        tag = mix((band[owner].astype(U) << U(48)) + (U(seed) << U(40)) + number.astype(U))
        keys.append(mix(parity[full] ^ tag[full]))
        owners.append(set_of[owner[full]])
        empty = count - np.add.reduceat(full.astype(np.int64), base[:-1])
        again = count < differ + empty + 1
        need = np.searchsorted(NEEDS, np.where(again | (seed > 0), 1, count - differ - empty), "right") - 1
        marks.append((need + 128 * (BANDS[band] < size))[owner[full]].astype(np.uint8))
        set_of, band, count, differ = set_of[again], band[again], count[again], differ[again]
        seed += 1
    return (np.concatenate(keys), np.concatenate(owners), np.concatenate(marks)) if keys else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint8))


def bits_of(band: int) -> int:
    return 1 << max(6, int(4 * BANDS[band] - 1).bit_length())


def sketch(tokens: np.ndarray, band: int) -> bytes:
    """The dense parity sketch of a set in a band."""
    bits = bits_of(band)
    return np.packbits(np.bincount((mix(tokens ^ SALT) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = shingles(Words(*bytes_of(part.column("text"))), size)
                n = np.diff(at)
                band = np.searchsorted(BANDS, n)
                own, guest = [], []
                for a, b, m, j in zip(at[:-1].tolist(), at[1:].tolist(), n.tolist(), band.tolist(), strict=True):
                    own.append(sketch(h[a:b], j) if m else None)
                    guest.append(sketch(h[a:b], j - 1) if m and j and m <= BANDS[j - 1] * 100 // percent else None)
                cols = [part.column("doc_id"), part.column("row"), pa.array(nodes_of(h, at).view(np.int64)), names_of(h, at), pa.array(n), pa.array(band, pa.int32()), pa.array(own, pa.binary()), pa.array(guest, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "node", "name", "n", "band", "own", "guest"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, SIG)


def _blobs(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Packed (key, node, mark) records by bucket of the key."""

    def flush(keys: list, nodes: list, marks: list) -> Iterator[pa.RecordBatch]:
        key, node, mark = np.concatenate(keys), np.concatenate(nodes), np.concatenate(marks)
        bucket = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")
        bucket, key, node, mark = bucket[order], key[order], node[order], mark[order]
        # the upper half's leading bits are the bucket; 48 bits below tell keys apart within it
        low, high = (key & U(0xFFFFFFFF)).astype(np.uint32), (key >> U(32) & U(0xFFFF)).astype(np.uint16)
        present, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(bucket))
        cols = [[x[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)] for x in (low, high, node, mark)]
        yield pa.RecordBatch.from_arrays([pa.array(present), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "low", "high", "nodes", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        count = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = shingles(Words(*bytes_of(part.column("text"))), size)
                node = nodes_of(h, at)
                _, first = np.unique(node, return_index=True)  # copies within the piece give their keys once
                n = np.diff(at)[first]
                h, at = h[gathered(at[first], n)], np.concatenate([[0], np.cumsum(n)])
                key, of, mark = keys_of(h, at, percent)
                for own, new in zip(held, (key, node[first][of], mark), strict=True):
                    own.append(new)
                count += len(key)
                if count > FLUSH_KEYS:
                    yield from flush(*held)
                    held, count = ([], [], []), 0
        if count:
            yield from flush(*held)

    return docs.select("text").mapInArrow(run, "bucket long, low binary, high binary, nodes binary, marks binary")


def _runs(table: pa.Table) -> pa.Table:
    """Of one bucket: the members of its runs, with each run's length."""
    cols = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("low", np.uint32), ("high", np.uint16), ("nodes", U), ("marks", np.uint8))]
    key, node, mark = cols[0].astype(U) | cols[1].astype(U) << U(32), cols[2], cols[3]
    order = np.lexsort((node, key))
    key, node, mark = key[order], node[order], mark[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, mark = key[new], node[new], mark[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(begin, len(key)))
    some = length > 1
    at = gathered(begin[some], length[some])
    names = mix(key[at] + mix(np.full(1, table.column("bucket")[0].as_py(), U))[0]).view(np.int64)
    return pa.table({"run": names, "length": np.repeat(length[some], length[some]), "node": node[at].view(np.int64), "need": NEEDS[mark[at] & 127].astype(np.int32), "guest": pa.array(mark[at] > 127)})


def _allowed(na: int, nb: int, percent: int) -> int:
    """The most tokens in which sets of these sizes may differ, -1 if they can't link."""
    return -1 if 100 * min(na, nb) < percent * max(na, nb) else (na + nb) * (100 - percent) // (100 + percent)


def _only(sig: DataFrame, names: DataFrame) -> DataFrame:
    """One signature of each of the nodes. A short list of them goes to the signatures, so that these aren't shuffled."""
    need = written(names.distinct(), "nodes")
    few = need.count() <= SENT_ROWS  # 16 bytes each
    return sig.join(F.broadcast(need) if few else need, "name", "left_semi").dropDuplicates(["name"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))


def _members(found: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of nodes that may have a partner, with the node's weight: how many and how long its runs are."""
    m = found.withColumn("weight", F.sum("length").over(Window.partitionBy("node")))
    m = m.withColumn("runs", F.count("*").over(Window.partitionBy("node", "guest"))).filter("runs >= need").drop("length", "runs")
    return m.join(reps.select("node", "name", "n"), "node").drop("node")  # sets of an equal 64-bit node are all members


def _first_pairs(members: DataFrame) -> DataFrame:
    """Each node with the most central node of most of its runs, but for nodes that are that themselves; pairs that don't
    meet as often as partners do are left to the search across components."""
    centre = members.groupBy("run").agg(F.max(F.struct("weight", "name")).alias("c")).select("run", F.col("c.name").alias("a"))
    shared = members.select("run", "name", "need").join(centre, "run").filter("a <> name").groupBy("name", "a").agg(F.count("*").alias("k"), F.min("need").alias("need"))
    best = shared.filter("k >= need").groupBy("name").agg(F.max(F.struct("k", "a")).alias("best"))
    return best.select(F.least("best.a", "name").alias("a"), F.greatest("best.a", "name").alias("b")).distinct()


def _close(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs whose dense sketches keep to the Hamming bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            cols = [batch.column(c).to_pylist() for c in ("an", "bn", "ab", "bb", "ao", "bo", "ag", "bg")]
            for na, nb, ja, jb, oa, ob, ga, gb in zip(*cols, strict=True):
                x, y = (oa, ob) if ja == jb else (oa, gb) if ja < jb else (ga, ob)
                most = _allowed(na, nb, percent)
                near = x is None or y is None or (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= most
                keep.append(most >= 0 and near)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sig = written(_only(sig, _ends(pairs)), "ends")
    side = lambda s: sig.select(F.col("name").alias(s), F.col("n").alias(s + "n"), F.col("band").alias(s + "b"), F.col("own").alias(s + "o"), F.col("guest").alias(s + "g"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of nodes whose sets reach the threshold."""
    need = written(_ends(pairs).distinct().join(reps, "name").select("name", "row"), "need")
    few = need.count() <= SENT_ROWS  # 24 bytes each; beyond that the documents are shuffled
    found = docs.select("row", "text").join(F.broadcast(need) if few else need, "row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = shingles(Words(*bytes_of(part.column("text"))), size)
                right = pa.array([x == y for x, y in zip(names_of(h, at).to_pylist(), part.column("name").to_pylist(), strict=True)], pa.bool_())
                raw = [h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(raw, pa.binary())], names=["name", "tokens"]).filter(right)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tokens = written(found.select("name", "text").mapInArrow(sets, "name binary, tokens binary").dropDuplicates(["name"]), "sets")
    both = pairs.join(tokens.select(F.col("name").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(tokens.select(F.col("name").alias("b"), F.col("tokens").alias("y")), "b")
    return both.mapInArrow(check, "a binary, b binary")


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members of runs with several components: with their component, the run's largest one, and its numbers."""
    known = label.select(F.col("id").alias("name"), "component")
    m = members.join(known, "name", "left").withColumn("component", F.coalesce("component", "name"))
    per = m.groupBy("run", "component").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    runs = per.groupBy("run").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("main"), F.sum(F.col("size") * F.col("size")).alias("square"), F.max("n").alias("widest"))
    runs = runs.filter("parts > 1").select("run", "all", F.col("main.component").alias("main"), F.col("main.size").alias("inside"), (F.col("all") * F.col("all") - F.col("square")).alias("cost"), "widest")
    return m.join(runs, "run")


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of mixed runs in which pairs across components must be looked for: each such pair is left in the cheapest run
    that it shares. A node shares ``need`` runs with a partner, all of them mixed, so the costliest ``need - 1`` may go.
    Of runs with the same rows one is left, told by 128 bits of the rows' sums."""
    order = Window.partitionBy("name", "guest").orderBy(F.desc("cost"), "run")
    m = _mixed(members, label).withColumn("rank", F.row_number().over(order)).filter("rank >= need")
    m = written(m.select("run", "name", "guest", "n"), "cheap")
    total = lambda salt: F.sum(F.xxhash64("name", "guest", F.lit(salt)).cast("decimal(20,0)"))
    same = m.groupBy("run").agg(F.count("*").alias("size"), total(1).alias("x"), total(2).alias("y")).filter("size > 1")
    return m.join(same.groupBy("size", "x", "y").agg(F.min("run").alias("run")).select("run"), "run", "left_semi")


def _across(members: DataFrame, sig: DataFrame, label: DataFrame, percent: int, top: int) -> DataFrame:
    """Pairs across components within runs that keep to the Hamming bound, compared cell by cell.

    Every such pair has an end outside the run's largest component; each node outside gives its ``top`` nearest
    partners in a cell. A row without a pair names a run in which a node has others.
    """
    m = _mixed(members, label)
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / F.col("widest"))))
    blocks = lambda c: F.ceil(c / block).cast("int")
    m = m.withColumn("out", F.col("component") != F.col("main")).withColumn("ins", blocks(F.col("inside"))).withColumn("outs", blocks(F.col("all") - F.col("inside")))
    m = m.withColumn("slice", F.pmod(F.xxhash64("name"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    # cell (i, j): slice i inside with slice j outside; cell (-1 - i, j): two slices outside
    span = lambda n: F.sequence(F.lit(0), n - 1)
    inner = F.transform(span(F.col("outs")), lambda j: F.struct(F.col("slice").alias("i"), j.alias("j")))
    outer = F.transform(span(F.col("ins")), lambda i: F.struct(i.alias("i"), F.col("slice").alias("j")))
    others = F.transform(F.filter(span(F.col("outs")), lambda k: k != F.col("slice")), lambda k: F.struct((-1 - F.least(k, F.col("slice"))).alias("i"), F.greatest(k, F.col("slice")).alias("j")))
    m = m.withColumn("cell", F.explode(F.when(F.col("out"), F.concat(outer, others)).otherwise(inner)))
    m = written(m.select("run", "guest", "name", "component", "out", "slice", F.col("cell.i").alias("i"), F.col("cell.j").alias("j")), "mixed")
    bits = _only(sig, m.select("name")).select("name", "n", "band", "own", F.col("guest").alias("other"))
    m = m.join(bits, "name").withColumn("bits", F.when(F.col("guest"), F.col("other")).otherwise(F.col("own")))
    m = m.withColumn("band", F.col("band") - F.col("guest").cast("int")).drop("own", "other", "guest")

    def compare(t: pa.Table) -> pa.Table:
        comp = t.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        n, out, part, name = t.column("n").to_numpy(), t.column("out").to_numpy(), t.column("slice").to_numpy(), t.column("name").combine_chunks()
        x = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        first, run = t.column("i")[0].as_py(), t.column("run")[0].as_py()
        a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
        for k in np.flatnonzero(out):
            other = comp != comp[k]
            if first < 0:
                other &= part != part[k]
            elif first > 0:
                other &= ~out  # those outside meet each other in slice 0
            other = np.flatnonzero(other & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])))
            apart = np.bitwise_count(x[other] ^ x[k]).sum(axis=1)
            near = apart <= (n[other] + n[k]) * (100 - percent) // (100 + percent)
            other, apart = other[near], apart[near]
            more |= len(other) > top
            best = other[np.argsort(apart, kind="stable")[:top]]
            a.append(np.full(len(best), k))
            b.append(best)
        a, b = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
        rows = pa.table({"run": pa.nulls(len(a), pa.int64()), "a": name.take(a), "b": name.take(b)})
        return pa.concat_tables([rows, pa.table({"run": [run], "a": pa.nulls(1, pa.binary()), "b": pa.nulls(1, pa.binary())})]) if more else rows

    return m.groupBy("run", "band", "i", "j").applyInArrow(compare, "run long, a binary, b binary")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """Per document: ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    with scratch():
        return _join(docs, size, percent)


def _join(docs: DataFrame, size: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    sig = written(_signatures(docs, size, percent), "signatures")
    some = sig.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("node").alias("node"), F.first("n").alias("n"))
    reps = written(some, "reps")
    buckets = max(1, -(-size_of(docs) // BUCKET_BYTES))
    found = written(_blobs(docs, size, percent, buckets).groupBy("bucket").applyInArrow(_runs, "run long, length long, node long, need int, guest boolean"), "runs")
    members = written(_members(found, reps), "members")
    pairs = written(_close(_first_pairs(members), sig, percent), "pairs")
    label = components(_verified(pairs, docs, reps, size, percent))
    members, tried, top = written(_open(members, label), "open"), pairs, NEAREST
    while not members.isEmpty():
        near = written(_across(members, sig, label, percent, top), "near")
        pairs = near.filter("run IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            label = written(_merged(label, written(_verified(pairs, docs, reps, size, percent), "links")), "label")
            tried = tried.unionByName(pairs)
        # all pairs of the other runs were given out; those of these that are still in two components come next
        members = written(members.join(near.filter("run IS NOT NULL").select("run").distinct(), "run", "left_semi"), "open")
        top *= 8
    label = label.select(F.col("id").alias("name"), "component")
    least = label.join(reps, "name").groupBy("component").agg(F.min("rep").alias("least"))
    label = label.join(least, "component").select("name", "least")
    groups = reps.join(label, "name", "left").select("name", F.coalesce("least", "rep").alias("least"))
    out = sig.select("doc_id", F.when(F.col("n") > 0, F.col("name")).alias("name"), "n").join(groups, "name", "left")
    return written(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")), "components", keep=True)


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after some more edges, which are contracted to the components known so far."""
    left, right = (label.select(F.col("id").alias(s), F.col("component").alias("c" + s)) for s in "ab")
    between = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = written(between, "between")
    over = components(between).select(F.col("id").alias("component"), F.col("component").alias("final"))
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    lone = ends.join(label, "id", "left_anti").distinct().select("id", F.col("id").alias("component"))
    return label.unionByName(lone).join(over, "component", "left").select("id", F.coalesce("final", "component").alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op8_jaccard_join``: five-word shingles, links at 80 percent."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each component the document with the smallest id stays, and of rows that share this id
    one; rows with a null id stay."""
    stays = (F.col("component_id") == F.col("doc_id")).cast("int")
    per = join(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(stays).alias("n"))
    gone = written(per.filter("n = 0").select(F.col("doc_id").alias("gone")), "gone")
    few = gone.count() <= SENT_ROWS  # 8 bytes each; beyond that the documents are shuffled
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone"], "left_anti")
    twice = written(per.filter("n > 1").select(F.col("doc_id").alias("twice")), "twice")
    if twice.isEmpty():
        return kept
    same = kept["doc_id"] == twice["twice"]
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common WHERE 100 * shared >= 80 * (na + nb - shared)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(id, seen) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.seen FROM r JOIN edges e ON e.u = r.id WHERE r.seen < e.v)
  SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN reach r ON r.id = s.doc_id
"""
