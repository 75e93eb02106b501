"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds the 64-bit hashes of its distinct shingles; documents
with equal sets are one class, known by the set's signature, and never paired.
Two classes can only reach similarity t if they share tokens in their prefixes
under *every* total order of the tokens, so several orders are intersected:

* order 0 (corpus-wide heavy tokens last, else by hash) on all classes. Its
  prefix is longer by a share ``extra`` of the set, so partners must share not
  one but several prefix tokens: classes without enough tokens that another
  class has too are done.
* order 1 (rarest first among the tokens that survive order 0) makes the
  candidates: pairs that share a token of the prefix nested in the survivors.
* orders 2 and on (seeded permutations) must each show a shared prefix token
  before a pair is verified exactly.

Only components are wanted, so the classes of a token are gathered about one of
them, its hub: whoever shares a prefix token shares a hub. Each class is compared
with its hub first, in a join salted by the class; those similar to the hub are
one component. Only the rest still has pairs to prove, among itself and with the
linked ones; they are dealt out in tiles of bounded size, where pairs not yet in
one component are looked at by length, by an exact lower bound on the symmetric
difference (xor of parity bitmaps) and by the further orders, before they are
verified. What leaves a tile is a spanning forest of its links, so no link between
components is lost and no group is expanded into all its pairs. Heavy tokens need
no count, so they are split into grains.

Defined results: null text and text without words has no set (n_shingles 0,
its own component); rows that repeat a doc_id are separate documents; a null
doc_id never lends its id to a component (its own component is null when it is
alone); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import fresh, map_arrow, mix, raw_texts, slices, span_hashes, use_checkpoints, words
from attrition.llm.components import components

WIDTH = 5
#: At most this many tokens can each make up the 2**-20th part of all tokens.
HEAVY_PART = 1 << 20
ORDERS = 2
#: Rows of 16 bytes that a join may broadcast.
BROADCAST_ROWS = 1 << 20
#: Classes of a hub that meet those of another tile, and grains into which a heavy token is split.
TILE, SALTS = 512, 1 << 20
#: Parts of a hub's classes, each with a copy of the hub's set.
HUB_SALTS = 64
_MULTIPLIERS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one as a whole."""
    data, start, end, first = words(texts)
    h = span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    n = max(0, len(h) - WIDTH + 1)
    s = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        s += h[k : n + k] * _MULTIPLIERS[k]
    s = mix(s)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= WIDTH:
            out.append(np.unique(s[a : b - WIDTH + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(s[:0])
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set (0, 0 if empty)."""
    if not len(tokens):
        return 0, 0
    a = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(tokens + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(mix(np.array([a]))[0].astype(np.int64)), int(mix(np.array([b + np.uint64(len(tokens))]))[0].astype(np.int64))


def prefix_length(n: int, percent: int, more: int = 1) -> int:
    """How many tokens of a set of n must be looked at to meet ``more`` of those it shares with any partner."""
    return min(n, n - -(-percent * n // 100) + more)


def least_shared(n: int, extra: float) -> int:
    return 1 + int(extra * n)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, row_key, sig, sig2, n) per document, and rows (token, count) of tokens that are frequent nearby."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= (2 if size < 1 << 20 else 4)
        none = pa.nulls(int(often.sum()), pa.int64())
        return _batch(schema, none, none, none, none, count[often], token[often].astype(np.int64))

    for whole in batches:
        for batch in slices(whole):
            sets = shingle_sets(raw_texts(batch.column("text")))
            sig, sig2 = zip(*map(signature, sets), strict=True)
            yield _batch(schema, batch.column("doc_id"), batch.column("row_key"), sig, sig2, [len(s) for s in sets], pa.nulls(len(sets), pa.int64()))
            held += sets
            size += sum(map(len, sets))
            if size > 1 << 22:
                yield frequent()
                held, size = [], 0
    if size:
        yield frequent()


def _postings(percent: int, extra: float, heavy):
    """(token, salt, sig) of the prefix under order 0, once per class and task; salt is 0 but for heavy tokens."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("sig", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = heavy.value, set()
        for whole in batches:
            for batch in slices(whole):
                token, salt, sig, size = [], [], [], []
                for s in shingle_sets(raw_texts(batch.column("text"))):
                    name = signature(s)[0]
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    p, light = prefix_length(len(s), percent, least_shared(len(s), extra)), len(s)
                    if len(last):
                        is_heavy = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s, light = np.concatenate([s[~is_heavy], s[is_heavy]]), int((~is_heavy).sum())
                    token.append(s[:p])
                    salt.append(np.where(np.arange(p) < light, 0, 1 + name % SALTS))
                    sig.append(name)
                    size.append(p)
                if token:
                    yield _batch(schema, np.concatenate(token).astype(np.int64), np.concatenate(salt).astype(np.int32), np.repeat(np.array(sig, np.int64), size))

    return run


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens per bit, in words; four to eight bits for each token."""
    bits = max(64, 4 << int(len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, tokens) of the wanted classes, once per class and task."""
    schema = pa.schema([("sig", pa.int64()), ("tokens", pa.binary())])
    seen = set()
    for whole in batches:
        for batch in slices(whole):
            rows = []
            for sig, s in zip(batch.column("sig").to_pylist(), shingle_sets(raw_texts(batch.column("text"))), strict=True):
                if sig not in seen and signature(s)[0] == sig:
                    seen.add(sig)
                    rows.append((sig, s.tobytes()))
            if rows:
                yield _batch(schema, *zip(*rows, strict=True))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Shared prefix tokens under each further order, then the exact similarity."""
    for seed in range(1, ORDERS + 1):
        turn = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        tops = []
        for s in (x, y):
            p = prefix_length(len(s), percent)
            key = mix(s ^ turn)
            tops.append(np.partition(key, p - 1)[:p] if p < len(key) else key)
        if not len(np.intersect1d(*tops, assume_unique=True)):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _close(parity: list[np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """False where the parity bits prove that the sets differ in too many tokens."""
    ok = (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])
    most = (100 - percent) * (n[a] + n[b]) // (100 + percent)  # symmetric difference at the threshold
    size = np.array([len(p) for p in parity])
    narrow = np.minimum(size[a], size[b])
    for width in np.unique(narrow[ok]):
        used = np.flatnonzero(ok & (narrow == width))
        rows = np.unique(np.concatenate([a[used], b[used]]))
        folded = np.stack([np.bitwise_xor.reduce(parity[r].reshape(-1, width), axis=0) for r in rows])
        for at in range(0, len(used), 1 << 14):
            u = used[at : at + (1 << 14)]
            diff = folded[np.searchsorted(rows, a[u])] ^ folded[np.searchsorted(rows, b[u])]
            ok[u] = np.bitwise_count(diff).sum(1) <= most[u]
    return ok


def links_of_tile(sets: list[np.ndarray], label: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], percent: int, step: int = 1 << 18) -> list[tuple[int, int]]:
    """A spanning forest of the similar ones of the given pairs; sets of one label count as linked already."""
    label, links = label.copy(), []
    n = np.array([len(s) for s in sets])
    parity: list[np.ndarray] = []
    for at in range(0, len(pairs[0]), step):
        a, b = (x[at : at + step] for x in pairs)
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        parity = parity or [parity_bits(s) for s in sets]
        close = _close(parity, n, a, b, percent)
        for i, j in zip(a[close].tolist(), b[close].tolist(), strict=True):
            if label[i] != label[j] and _linked(sets[i], sets[j], percent):
                links.append((i, j))
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return links


def _tiles(percent: int):
    """Walks rows sorted by tile and links what each holds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key = ("hub", "row", "col")

    def links(rows: pa.Table) -> pa.RecordBatch:
        tile = np.stack([rows.column(c).to_numpy() for c in key], 1)
        sig, own, linked = (rows.column(c).to_numpy() for c in ("sig", "own", "linked"))
        tokens = rows.column("tokens").to_pylist()
        first = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(1))).tolist()
        found = []
        for a, b in zip(first, [*first[1:], len(sig)], strict=True):
            _, row, col = tile[a]
            there, at = np.unique(sig[a:b], return_index=True)  # a class may have come from several tasks
            if len(there) < 2:
                continue
            sets = [np.frombuffer(tokens[a + k], np.uint64) for k in at]
            i, j = np.triu_indices(len(sets), 1)
            if row != col:
                across = own[a + at[i]] != own[a + at[j]]
                i, j = i[across], j[across]
            label = np.where(linked[a + at], len(at), np.arange(len(at)))  # those linked with the hub are one
            found += [(there[x], there[y]) for x, y in links_of_tile(sets, label, (i, j), percent)]
        return _batch(schema, *(zip(*found, strict=True) if found else ([], [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the tile that isn't over
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(c).to_numpy() for c in key], 1)
            old = [held[0].column(c)[0].as_py() for c in key] if held else tile[0].tolist()
            if tile[-1].tolist() == old:
                held.append(batch)
                continue
            cut = int(np.flatnonzero((tile != tile[-1]).any(1))[-1]) + 1 if (tile != tile[-1]).any() else 0
            yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _with_hub(percent: int):
    """(hub, sig, salt, linked): whether the two sets of a row are similar."""
    schema = pa.schema([("hub", pa.int64()), ("sig", pa.int64()), ("salt", pa.int32()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("tokens").to_pylist(), batch.column("hub_tokens").to_pylist(), strict=True)
            sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
            linked = [100 * len(x) >= percent * len(y) and 100 * len(y) >= percent * len(x) and _linked(x, y, percent) for x, y in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hub", "sig", "salt")), pa.array(linked, pa.bool_())], schema=schema)

    return run


def hub_links(members: DataFrame, sets_of: Callable, percent: int) -> DataFrame:
    """Links (a, b) among the classes of each hub, from rows (hub, sig); ``sets_of``
    gives the sets of the classes asked for.

    First every class is compared with its hub, by rows salted with the class. Those
    linked with the hub are one component; only the others (open) still have pairs to
    prove, with each other and with the linked ones. These pairs are dealt to tiles of
    at most two chunks of classes."""
    salt = F.pmod(F.xxhash64("sig"), F.lit(HUB_SALTS)).cast("int")
    members = members.where("sig <> hub").withColumn("salt", salt)
    hubs = members.select("hub", "salt").distinct()
    hubs = hubs.join(sets_of(hubs.select(F.col("hub").alias("sig"))).select(F.col("sig").alias("hub"), F.col("tokens").alias("hub_tokens")).hint("merge"), "hub")
    pairs = members.join(sets_of(members.select("sig")), "sig").join(hubs.hint("merge"), ["hub", "salt"])
    told = map_arrow(pairs.select("hub", "sig", "salt", "tokens", "hub_tokens"), _with_hub(percent), "hub long, sig long, salt int, linked boolean").distinct().checkpoint()

    # counts of a hub from at most HUB_SALTS rows
    whole = W.partitionBy("hub")
    size = told.groupBy("hub", "salt").agg(F.count_if(~F.col("linked")).alias("open"), F.count_if("linked").alias("closed"))
    size = size.select("hub", "salt", F.sum("open").over(whole).alias("open"), F.sum("closed").over(whole).alias("closed")).where("open > 0 and open + closed > 1")
    size = size.select("hub", "salt", *[F.ceil(F.col(c) / TILE).cast("int").alias(c) for c in ("open", "closed")])
    chunk = lambda n: F.pmod(F.xxhash64("sig", F.lit(1)), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = told.join(size, ["hub", "salt"]).withColumn("own", F.when(F.col("linked"), F.col("open") + chunk("closed")).otherwise(chunk("open")))
    # an open class meets every chunk, a linked one the open chunks
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("linked"), F.col("open")).otherwise(F.col("open") + F.col("closed")) - 1)))
    rows = rows.select("hub", "sig", "linked", "own", F.least("own", "k").alias("row"), F.greatest("own", "k").alias("col")).checkpoint()
    rows = rows.join(sets_of(rows.select("sig")), "sig")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "hub", "row", "col").sortWithinPartitions("hub", "row", "col")
    return told.where("linked").select(F.col("hub").alias("a"), F.col("sig").alias("b")).unionByName(map_arrow(dealt, _tiles(percent), "a long, b long"))


def _grouped(docs: DataFrame, percent: int, extra: float) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, row_key, sig, sig2, n) per document, and classes (sig, sig2, rep, component) of those with a set."""
    spark = docs.sparkSession
    use_checkpoints(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    seen = map_arrow(docs, _summaries, "doc_id long, row_key long, sig long, sig2 long, n long, token long").checkpoint()
    summary = seen.where("sig is not null").drop("token")
    classes = summary.where("n > 0").groupBy("sig", "sig2", "n").agg(
        F.min("doc_id").alias("rep"), F.coalesce(F.min_by("row_key", "doc_id"), F.min("row_key")).alias("rep_key")
    )
    total = summary.agg(F.sum("n")).first()[0] or 0
    frequent = seen.where("token is not null").groupBy("token").agg(F.sum("n").alias("c")).where(F.col("c") * HEAVY_PART > total)
    heavy = np.sort(frequent.select("token").toArrow().column("token").to_numpy().astype(np.uint64))  # at most HEAVY_PART, 8 bytes each

    postings = map_arrow(docs, _postings(percent, extra, spark.sparkContext.broadcast(heavy)), "token long, salt int, sig long")
    # a window's group is a token that isn't heavy, or a grain of a heavy one, so about the 2**-20th part of all at most
    group = W.partitionBy("token", "salt")
    counted = postings.select("token", "salt", "sig", F.count("*").over(group).alias("df"), F.min("sig").over(group).alias("lo"), F.max("sig").over(group).alias("hi"))
    counted = counted.where("salt > 0 or lo <> hi").select("sig", F.struct(F.when(F.col("salt") > 0, F.lit(1 << 40)).otherwise(F.col("df")).alias("df"), "token").alias("token"))
    shared = counted.groupBy("sig").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    partner = F.floor((F.col("n") * percent + 99) / 100)  # size of the smallest possible partner
    shared = shared.join(classes.select("sig", "n").distinct(), "sig").withColumn("least", (1 + F.floor(partner * extra)).cast("int"))
    alive = shared.where(F.size("tokens") >= F.col("least"))
    posts = alive.select("sig", F.explode(F.slice(F.col("tokens.token"), F.lit(1), F.size("tokens") - F.col("least") + 1)).alias("token")).checkpoint()

    hubs = posts.groupBy("token").agg(F.min("sig").alias("hub"), F.max("sig").alias("last")).where("hub <> last")
    members = posts.join(hubs, "token").select("hub", "sig").distinct().checkpoint()
    wanted = classes.join(members.select("sig").distinct(), "sig").select("rep", "rep_key", "sig").checkpoint()
    few = wanted.count() <= BROADCAST_ROWS

    def sets_of(sigs: DataFrame) -> DataFrame:
        """(sig, tokens) of the classes, made anew from their texts: less to do than to keep them."""
        asked = wanted.join(sigs.distinct(), "sig")
        asked = F.broadcast(asked) if few else asked  # else the texts are shuffled to the rows wanted
        texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("row_key") == F.col("rep_key"))).select("sig", "text")
        return map_arrow(texts, _sets, "sig long, tokens binary").hint("merge")  # sets are shuffled, never broadcast, at any size

    groups = components(hub_links(members, sets_of, percent)).withColumnRenamed("node", "sig")

    named = classes.join(groups, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    return summary, named


def similar_groups(docs: DataFrame, percent: int = 75, extra: float = 0.1) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    summary, named = _grouped(docs, percent, extra)
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = named.join(lowest, "component").select("sig", "sig2", "component_id")
    return summary.join(per_class, ["sig", "sig2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, in their own columns, whose doc_id is the smallest of their group.
    Rows that repeat a doc_id stay or go together; rows with a null doc_id stay."""
    groups = similar_groups(docs, percent)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def one_of_groups(docs: DataFrame, percent: int = 75, extra: float = 0.1) -> DataFrame:
    """One document of each group, in its own columns: the one of the smallest doc_id (null last),
    then of the smallest hash of the text; of rows equal in both, one. Rows are told apart by doc_id
    and text, so a text never goes for another one's sake; documents without words all stay."""
    summary, named = _grouped(docs, percent, extra)
    named = named.select("sig", "sig2", "component")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    first = summary.where("n > 0").groupBy("sig", "sig2").agg(F.min(key).alias("first"))
    first = first.join(named, ["sig", "sig2"]).groupBy("component").agg(F.min("first").alias("first"))
    rows = summary.join(named.join(first, "component"), ["sig", "sig2"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    name, text_key, chosen = (fresh(c, docs.columns) for c in ("group_doc_id", "group_row_key", "group_chosen"))
    keys = rows.groupBy(F.col("doc_id").alias(name), F.col("row_key").alias(text_key)).agg(F.bool_or(stays).alias(chosen), F.count("*").alias("times"))
    settled = keys.where(~F.col(chosen) | (F.col("times") > 1)).drop("times").checkpoint()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(text_key))
    repeated = docs.join(settled.where(chosen), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(settled, same, "left_anti").unionByName(repeated)


GROUPS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sizes LEFT JOIN low ON low.a = doc_id
"""
