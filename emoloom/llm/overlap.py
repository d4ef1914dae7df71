"""Problem 6: evaluation records that also stand, exactly or almost, in training.

Two texts overlap when their canonical keys (see ``dedup``) are equal or when
at least nine tenths of the words of the longer stand in the other in the same
order.  Then most of their word n-grams are shared: a word that stands alone
breaks three of them at most, or two where it was put in.  Sorted by one order
common to all texts, rarest words first, the n-grams beyond those that can be
broken need not be looked at (``prefix``).  The evaluation n-grams' hashes are
the index: training texts are scanned for them, a bit table of bounded size
drops the others before the shuffle, and pairs that meet at places and lengths
that fit are measured by their longest common subsequence.  Nothing is lost:
the smallest shared n-gram is among those kept on both sides.

Equal word lists count once (a class), on either side; copies are joined back
at the end.  Not cases: texts that are null, have three words or fewer, or
have no letter or digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .dedup import Keys
from .lookalike import confusables, is_case, pairs_of, spellings, with_forms

TENTHS = 9  # of the longer text's words that must stand in the other
GRAM = 3  # words
BITS = (20, 29)  # the bit table has 16 bits or more for each evaluation n-gram, 2**29 (64 MB) at most
SLOTS = (16, 23)  # n-grams are counted in as many slots as there are, 2**23 (32 MB) at most
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@lru_cache(4096)
def prefix(words: int) -> int:
    """How many n-grams of a text of so many words can be broken in all, plus one."""
    most = 0
    for other in range(-(-TENTHS * words // 10), 10 * words // TENTHS + 1):
        common_ = -(-TENTHS * max(words, other) // 10)
        alone, put_in = words - common_, other - common_
        if alone >= 0 and put_in >= 0:
            most = max(most, GRAM * alone + (GRAM - 1) * put_in)
    return most + 1


def longest_common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of it at a time."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hits := at.get(x):
            new = row & hits
            row = ((row + new) | (row - new)) & full
    return len(a) - row.bit_count()


def containment(a: list[int], b: list[int]) -> float:
    """The share of the longer text's words that stand in the other in order."""
    return longest_common(a, b) / max(len(a), len(b), 1)


def hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all word n-grams of a list of word hashes."""
    words = words.view(np.uint64)
    n = max(len(words) - GRAM + 1, 0)
    own = words[:n] * _MIX[0]
    for k in range(1, GRAM):
        own = own + words[k : k + n] * _MIX[k]
    own ^= own >> np.uint64(29)
    return own * np.uint64(0xBF58476D1CE4E5B9)


def grams(sequence: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams to index and their places: the first of the common order
    (seldom in training, then by hash), all equal ones included.  The order
    decides how many candidates there are, never the result."""
    own = hashes(sequence)
    if len(sequence) < TENTHS:  # no other list is near: such are equal as a whole, which is joined by their hash
        own = own[:0]
    n = len(own)
    k = prefix(len(sequence))
    if k < n:
        rank = np.frexp(counts[own >> _shift(len(counts))] + 1.0)[1]
        order = np.lexsort((own, rank))
        last = order[k - 1]
        at = np.flatnonzero((rank < rank[last]) | ((rank == rank[last]) & (own <= own[last])))
    else:
        at = np.arange(n)
    return own[at], at


def _shift(size: int) -> np.uint64:
    """By how many bits a hash is shifted to fall in a table of so many places."""
    return np.uint64(64 - (size.bit_length() - 1))


def _bits(n: int, bounds: tuple[int, int]) -> int:
    """The binary logarithm of a table of ``n`` places, within bounds."""
    return min(max(n.bit_length(), bounds[0]), bounds[1])


def sequences(df: DataFrame, id_col: str, text: str, found: DataFrame | None) -> DataFrame:
    """(id, look, words, sequence): 128-bit hashes of the key and of the word
    list; the words' hashes in order.  ``found`` are the spellings of ``lookalike``."""
    common.ship(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(confusables(df.sparkSession))
    kept = common.fresh_key()
    kind = dict(df.select(id_col).dtypes)[id_col]
    of = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("id", of), ("look", pa.binary()), ("words", pa.binary()), ("sequence", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, memo = common.kept(kept, lambda: (Keys(known.value), {}))
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for i, t, forms in zip(common.column(batch, "id"), common.column(batch, "text"), common.column(batch, "forms")):
                if not is_case(t):
                    continue
                forms = pairs_of(forms)
                form = to.canonical.text(t, forms).lower()
                sequence = []
                for w in form.split():
                    h = memo.get(w)
                    if h is None:
                        s = to.strip("", w)
                        h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63) if s else ()
                        if len(memo) > 300_000:
                            memo.clear()
                        memo[w] = h
                    if h != ():
                        sequence.append(h)
                key = to.key(t, forms) if ":" in t or "：" in t else to.strip("", form)
                for c, x in zip(out, (i, digest(key.encode("utf-8", "surrogatepass")), digest(np.array(sequence, np.int64).tobytes()), sequence)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = common.rows_of(df, id=F.col(id_col), text=F.col(text)).where("text is not null and id is not null")
    return with_forms(rows, found, F.col("text")).mapInArrow(run, f"id {kind}, look binary, words binary, sequence array<long>")


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()[1:-1] - column.offsets.to_numpy()[0])


def _slot_counts(table: DataFrame) -> np.ndarray:
    """How many n-grams of all texts fall in each slot; about as many slots as n-grams."""
    total = table.agg(F.sum(F.size("sequence"))).first()[0] or 0
    slots = 1 << _bits(total, SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            if len(batch):
                all_ = np.concatenate([hashes(x) for x in _lists(batch, "sequence")])
                total += np.bincount((all_ >> _shift(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], names=["slot", "n"])

    got = table.select("sequence").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(slots, np.float32)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def _probes(own: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each n-gram in a table of 2**bits bits."""
    mask = np.uint64((1 << bits) - 1)
    return [(own >> np.uint64(by)) & mask for by in (64 - bits, 3)]


def _indexed(table: DataFrame, counts: np.ndarray, bits: np.ndarray | None = None) -> DataFrame:
    """(words, n, gram, place) of each text; with a bit table, only the n-grams whose bits are set."""
    sc = table.sparkSession.sparkContext
    known, wanted = sc.broadcast(counts), sc.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = []
            for row, sequence in enumerate(_lists(batch, "sequence")):
                own, at = grams(sequence, known.value)
                if wanted.value is not None:
                    keep = np.ones(len(own), bool)
                    for bit in _probes(own, len(wanted.value).bit_length() + 5):
                        keep &= (wanted.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    own, at = own[keep], at[keep]
                parts.append((np.full(len(own), row), np.full(len(own), len(sequence)), own, at))
            rows, n, own, at = (np.concatenate(x) for x in zip(*parts))
            words = batch.column(batch.schema.get_field_index("words")).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(at.astype(np.int32))], names=["words", "n", "gram", "place"])

    return table.select("words", "sequence").mapInArrow(run, "words binary, n int, gram long, place int")


def _bit_table(index: DataFrame) -> np.ndarray:
    """All n-grams' bits, 16 or more for each, gathered as machine words."""
    bits = _bits(16 * index.count(), BITS)
    probes = [F.expr(f"cast(shiftrightunsigned(gram, {by}) & {(1 << bits) - 1} as int)") for by in (64 - bits, 3)]
    some = index.select(F.explode(F.array(*probes)).alias("bit"))
    some = some.groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit & 63))").alias("word"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    got = some.toArrow()
    table[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return table


def shared_grams(a: list[int], b: list[int]) -> float:
    """The share of the distinct n-grams of ``a`` that ``b`` has; of lists too short for one, whether they are equal."""
    own, other = (set(hashes(np.array(x, np.int64)).tolist()) for x in (a, b))
    return len(own & other) / len(own) if own else float(a == b)


def _near(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share, grams_ = [], [], []
            for a, b in zip(common.column(batch, "e"), common.column(batch, "t")):
                least, there = -(-TENTHS * max(len(a), len(b)) // 10), set(b)
                lcs = longest_common(a, b) if sum(x in there for x in a) >= least else 0
                keep.append(lcs >= max(least, 1))
                share.append(lcs / max(len(a), len(b), 1))
                grams_.append(shared_grams(a, b) if keep[-1] else 0.0)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64()), pa.array(grams_, pa.float64())], names=["e_words", "t_words", "containment", "gram_containment"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return pairs.select("e_words", "t_words", "e", "t").mapInArrow(run, "e_words binary, t_words binary, containment double, gram_containment double")


def overlaps(evaluation: DataFrame, training: DataFrame, eval_id: str = "internal_id", train_id: str = "sample_id", text: str = "text") -> DataFrame:
    """(eval_id, train_id, containment, gram_containment): every overlapping pair
    once.  ``containment`` is the share of the longer text's words that stand in
    the other in order, ``gram_containment`` that of the evaluation record's
    n-grams that the training record has; equal keys have 1."""
    found = spellings(evaluation.select(text).unionByName(training.select(text)), text)
    e = common.cut(sequences(evaluation, eval_id, text, found), "eval")
    t = common.cut(sequences(training, train_id, text, found), "train")
    often = _slot_counts(t)
    index = common.cut(_indexed(e, often).distinct(), "index")
    hits = _indexed(t, often, _bit_table(index)).distinct()
    met = index.alias("e").join(hits.alias("t"), F.expr(f"""e.gram = t.gram and e.words <> t.words and abs(e.place - t.place) * 10 <= greatest(e.n, t.n)
        and least(e.n, t.n) * 10 >= greatest(e.n, t.n) * {TENTHS}"""))
    met = common.cut(met.select(F.col("e.words").alias("e_words"), F.col("t.words").alias("t_words")).distinct(), "met")

    def own(table: DataFrame, side: str) -> DataFrame:
        wanted = met.select(F.col(f"{side}_words").alias("words")).distinct()
        return table.join(wanted, "words", "left_semi").groupBy("words").agg(F.first("sequence").alias(side)).withColumnRenamed("words", f"{side}_words")

    near = _near(met.join(own(e, "e"), "e_words").join(own(t, "t"), "t_words"))
    some = near.join(e.select(F.col("words").alias("e_words"), F.col("id").alias("e_id")), "e_words")
    both = some.join(t.select(F.col("words").alias("t_words"), F.col("id").alias("t_id")), "t_words").select("e_id", "t_id", "containment", "gram_containment")
    for key in ("look", "words"):  # equal texts, and equal lists whose fields were parted otherwise
        same = e.select(key, F.col("id").alias("e_id")).join(t.select(key, F.col("id").alias("t_id")), key)
        both = both.unionByName(same.select("e_id", "t_id", F.lit(1.0).alias("containment"), F.lit(1.0).alias("gram_containment")))
    both = both.groupBy("e_id", "t_id").agg(F.max("containment").alias("containment"), F.max("gram_containment").alias("gram_containment"))
    return both.withColumnRenamed("e_id", eval_id).withColumnRenamed("t_id", train_id)


def report(evaluation: DataFrame, found: DataFrame, eval_id: str = "internal_id") -> DataFrame:
    """Counts of overlapping records and pairs by split and source, and the mean of their best n-gram containment."""
    pairs = found.groupBy(eval_id).agg(F.count("*").alias("pairs"), F.max("containment").alias("best"), F.max("gram_containment").alias("grams"))
    rows = evaluation.select(eval_id, "source_split", "source_dataset").join(pairs, eval_id, "left")
    return rows.groupBy("source_split", "source_dataset").agg(
        F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.count(F.when(F.col("best") == 1.0, 1)).alias("whole"), F.round(F.avg("grams"), 4).alias("gram_containment"))
