"""Interpolated modified Kneser-Ney bigram model, counted in Spark and applied where the texts are.

Words and pairs of words are hashes. Blocks of documents send their sorted distinct words and pairs with counts to the
owners of hash ranges; owners add up, and return to each block what the corpus knows of the block's own words, pairs
and contexts. That slice of the model, sorted hash arrays and values, is written to a file that the worker maps into
memory and looks up by binary search. No task holds the whole model. A word that makes up a large share of the corpus
is split as a context over many owners, and its statistics are put together in the totals.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import exchange as ex
from gneiss.llm import textbytes as tb

U = np.uint64
BEGIN, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Pairs have hashes of 64 bits: 36 of the context, 28 of the token that follows.
PAIR, SHIFT = 64, U(ex.ALIGN)
COUNTED = "block long, owner long, n long, codes binary, counts binary"


class Tokens:
    """Of some whole texts: hash of each token, each text's last being the end, and of the token before, and the text's number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = tb.lower_ascii(data)
        starts, ends, limits = tb.words(data, offsets)
        words = tb.word_hashes(data, starts, ends)
        n = np.diff(limits)
        self.token = np.insert(words, limits[1:], END)
        self.before = np.insert(words, limits[:-1], BEGIN)
        self.doc = np.repeat(np.arange(len(n)), n + 1)

    def words(self) -> np.ndarray:
        return self.token >> U(64 - ex.BITS)

    def contexts(self, hot: dict[int, int]) -> np.ndarray:
        """Context part of the pairs' hashes: of the token before, and for a hot one of a share of the tokens that follow."""
        part = self.before >> SHIFT
        for h, shares in hot.items():
            at = np.flatnonzero(self.before == U(h))
            part[at] = share_of(h, tb.mix(self.token[at]) % U(shares))
        return part

    def pairs(self, hot: dict[int, int]) -> np.ndarray:
        return (self.contexts(hot) << SHIFT) | (tb.mix(self.token) >> U(64 - ex.ALIGN))


def share_of(h: int, share: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(share + U(1)) ^ U(h)) >> SHIFT


def heavy_words(texts: DataFrame, share: float) -> dict[int, float]:
    """Hashes of tokens that make up `share` of all at least, about, by what they have in partitions where they do: at most 1 / share a partition. Used to deal work out evenly only."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            for a, b in tb.pieces(offsets):
                before = Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).before
                word, count = np.unique(before, return_counts=True)
                many = count >= max(2, share * len(before))
                word, count = np.append(word[many], U(0)), np.append(count[many], len(before))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])

    sums = texts.select("text").mapInArrow(kernel, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = {0: 1} | {r["word"]: r["n"] for r in sums.orderBy(F.desc("n")).limit(int(2 / share) + 1).collect()}
    return {w & ((1 << 64) - 1): n / total[0] for w, n in total.items() if w and n >= share * total[0]}


class Slice:
    """Sorted hashes and what the corpus knows of each, in a file mapped into memory."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.n, self.columns = len(keys), values.shape[0]
        with tempfile.TemporaryFile() as f:
            f.write(np.ascontiguousarray(keys, dtype="<u8").tobytes())
            f.write(np.ascontiguousarray(values, dtype="<i8").tobytes())
            f.flush()
            size = 8 * self.n
            self.keys = np.memmap(f, "<u8", "r", 0, (self.n,)) if self.n else np.empty(0, U)
            self.values = np.memmap(f, "<i8", "r", size, (self.columns, self.n)) if self.n else np.empty((self.columns, 0), np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.values[:, np.searchsorted(self.keys, keys)]


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, and 3 or more, of the numbers of things seen 1, 2, 3 and 4 times. Where one of these is 0, its discount is that of absolute discounting."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return np.array([min(max(x, 0.05 * (i > 0)), i) for i, x in enumerate(d)])


def _answers(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Merged hashes, their sums, each block's places among them, and the first block that counts each."""
    every = np.concatenate(codes)
    merged, place = np.unique(every, return_inverse=True)
    amount = np.concatenate(counts)
    total = np.bincount(place, weights=amount, minlength=len(merged)).astype(np.int64)
    number = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    first = np.full(len(merged), len(codes))
    np.minimum.at(first, place[amount > 0], number[amount > 0])
    return merged, total, np.split(place, np.cumsum([len(c) for c in codes])[:-1]), first


ANSWER = "block long, owner long, n long, values binary, extra binary, sizes array<long>, hot array<struct<part:long,c:long,n1:long,n2:long,n3:long>>"
_ANSWER = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("values", pa.binary()), ("extra", pa.binary()), ("sizes", pa.list_(pa.int64())), ("hot", pa.list_(pa.struct([(x, pa.int64()) for x in ("part", "c", "n1", "n2", "n3")])))])


def _frequencies(total: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(total, 5), minlength=6)
    return [int(total.sum()), int((total > 0).sum()), *map(int, n[1:5])]


def _opened(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n = table["n"].to_pylist()
    return [ex.rice_decode(c, k) for c, k in zip(table["codes"].to_pylist(), n, strict=True)], [ex.unpack_counts(c, k) for c, k in zip(table["counts"].to_pylist(), n, strict=True)]


def _words_answer(table: pa.Table) -> pa.Table:
    """Owner of words: sums of counts. Its first row alone carries its share of the totals: the sum, distinct words, and words counted 1 to 4 times."""
    table = table.combine_chunks()
    _, total, places, _ = _answers(*_opened(table))
    sizes = [_frequencies(total)] + [None] * (table.num_rows - 1)
    values = [ex.pack_counts(total[p]) for p in places]
    return pa.table([table["block"], table["owner"], table["n"], values, [None] * len(values), sizes, [None] * len(values)], schema=_ANSWER)


def _pairs_answer(hot: set[int]):
    def answer(table: pa.Table) -> pa.Table:
        """Owner of pairs: sums of counts, whether the block is the first to count a pair, and of each of the block's contexts its occurrences and how many tokens follow once, twice, or more often."""
        table = table.combine_chunks()
        table = table.take(np.argsort(table["block"].to_numpy()))
        merged, total, places, first = _answers(*_opened(table))
        start = _start(table)
        context, of = np.unique(merged >> SHIFT, return_inverse=True)
        kinds = [np.bincount(of, weights=w, minlength=len(context)).astype(np.int64) for w in (total, total == 1, total == 2, total > 2)]
        values, extra = [], []
        for i, p in enumerate(places):
            values.append(ex.pack_counts(total[p]) + np.packbits(first[p] == i).tobytes())
            own = np.unique(of[p])
            extra.append(len(own).to_bytes(8, "little") + b"".join(len(x := ex.pack_counts(k[own])).to_bytes(8, "little") + x for k in kinds))
        parts = [{"part": int(c + start), "c": int(a), "n1": int(x), "n2": int(y), "n3": int(z)} for c, a, x, y, z in zip(context, *kinds, strict=True) if int(c + start) in hot]
        rest = [None] * (table.num_rows - 1)
        return pa.table([table["block"], table["owner"], table["n"], values, extra, [_frequencies(total), *rest], [parts, *rest]], schema=_ANSWER)

    return answer


def _kinds(pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair of each kind of token, a place of it, and each token's kind. A token whose pair has the hash of another word's, as happens after words that many others follow, is a kind of its own."""
    pair, at, kind = np.unique(pairs, return_index=True, return_inverse=True)
    other = np.flatnonzero(words[at][kind] != words)
    kind[other] = len(at) + np.arange(len(other))
    return np.append(pair, pairs[other]), np.append(at, other), kind


def _start(table: pa.Table) -> U:
    """Context part with which the owner's range of hashes begins; it is sent as the range's number in the codes' order."""
    return U(table["start"][0].as_py())


def _sorted_rows(table: pa.Table, keys: np.ndarray) -> list[dict]:
    order = {int(k): i for i, k in enumerate(keys)}
    return sorted(table.to_pylist(), key=lambda r: order[r["owner"]])


def perplexity(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model is learned from rows for which `usable` holds; null counts as not. A-Z is lower-cased; tokens are runs of
    other than ASCII spaces, and one end for each text, null and empty ones too. base_score sums log10((c + 1) / (N + V
    + 1)) over tokens, c being a token's count among the N training tokens, V the distinct ones. score sums log10 of
    the model's p(token | token before), the text's begin before the first; a token that training lacks has the share
    of one in V + 1 of the lowest order's rest, so no score is infinite. n_known counts tokens with c > 0. Without
    training rows all tokens are equally likely. Ids are carried along, null or repeated.
    """
    spark = docs.sparkSession
    n, keys = ex.width_of(spark), ex.block_keys(ex.width_of(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(usable, F.lit(False)).alias("train"))
    heavy = heavy_words(rows, 0.5 / n) if n > 1 else {}
    hot = {h: max(2, int(np.ceil(2 * share * n))) for h, share in sorted(heavy.items())}
    parts = {h: [int(x) for x in share_of(h, np.arange(s, dtype=U))] for h, s in hot.items()}
    hot_parts = {p for own in parts.values() for p in own}
    blocks = rows.withColumn("block", ex.by_hash(spark, "id", "text")).repartition(n, "block")

    def tokens(table: pa.Table) -> Iterator[tuple[int, int, Tokens]]:
        data, offsets = tb.texts(table["text"])
        for a, b in tb.pieces(offsets):
            yield a, b, Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def counted(table: pa.Table, what: str) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct words or pairs, and how often training rows have each."""
        train = table["train"].to_numpy()
        found, counts = [np.empty(0, U)], [np.empty(0, np.int64)]
        for a, _, t in tokens(table):
            own, place = np.unique(t.words() if what == "words" else t.pairs(hot), return_inverse=True)
            found.append(own)
            counts.append(np.bincount(place, weights=train[a + t.doc], minlength=len(own)).astype(np.int64))
        own, place = np.unique(np.concatenate(found), return_inverse=True)
        return own, np.bincount(place, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)

    def send(what: str):
        def kernel(key: tuple, table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            own, counts = counted(table, what)
            return _with_start(ex.send(key[0].as_py(), own, n, keys, PAIR if what == "pairs" else ex.BITS, counts), keys, n)

        return kernel

    def pair_values(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums and first flags of the block's pairs, and four numbers of each of its contexts, all in order."""
        totals, firsts, contexts = [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty((4, 0), np.int64)]
        for r in _sorted_rows(answers, keys):
            size = 8 + r["n"] + 8 * int.from_bytes(r["values"][:8], "little")
            totals.append(ex.unpack_counts(r["values"], r["n"]))
            firsts.append(np.unpackbits(np.frombuffer(r["values"], np.uint8, offset=size), count=r["n"]).astype(bool))
            m, at, own = int.from_bytes(r["extra"][:8], "little"), 8, []
            for _ in range(4):
                length = int.from_bytes(r["extra"][at : at + 8], "little")
                own.append(ex.unpack_counts(r["extra"][at + 8 : at + 8 + length], m))
                at += 8 + length
            contexts.append(np.stack(own))
        return np.concatenate(totals), np.concatenate(firsts), np.hstack(contexts)

    def continuations(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """For each of the block's words, the pairs that end in it and that this block is the first to count."""
        if not table.num_rows:
            return _with_start(ex.send(key[0].as_py(), np.empty(0, U), n, keys, counts=np.empty(0, np.int64)), keys, n)
        table = table.combine_chunks()
        _, first, _ = pair_values(answers)
        words, ends = [np.empty(0, U)], [np.empty((2, 0), U)]
        for _, _, t in tokens(table):
            words.append(np.unique(t.words()))
            pair, at = np.unique(t.pairs(hot), return_index=True)
            ends.append(np.stack([pair, t.words()[at]]))
        own = np.unique(np.concatenate(words))
        pair, word = np.hstack(ends)
        distinct, at = np.unique(pair, return_index=True)
        count = np.bincount(np.searchsorted(own, word[at][first]), minlength=len(own)) if len(distinct) else np.zeros(len(own))
        return _with_start(ex.send(key[0].as_py(), own, n, keys, counts=count.astype(np.int64)), keys, n)

    def score(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * len(_SCORED), schema=_SCORED)
        table = table.combine_chunks()
        level = answers["level"].to_numpy()
        of = lambda k: answers.filter(pa.array(level == k)).drop_columns(["level", "totals"])
        sums = [np.concatenate([np.empty(0, np.int64)] + [ex.unpack_counts(r["values"], r["n"]) for r in _sorted_rows(of(k), keys)]) for k in (1, 3)]
        pair_total, _, contexts = pair_values(of(2))
        totals = answers.filter(pa.array(level == 0))["totals"][0].as_py()
        word_sizes, pair_sizes, ends_sizes = (totals[k] for k in ("words", "pairs", "ends"))
        # Each piece's distinct pairs and words, a place of each, and each token's number among them.
        kinds_of = [(a, b, t, *_kinds(t.pairs(hot), t.words())) for a, b, t in tokens(table)]
        own_words = np.unique(np.concatenate([t.words()[at] for _, _, t, _, at, _ in kinds_of]))
        own_pairs = np.unique(np.concatenate([pair for *_, pair, _, _ in kinds_of]))
        words, pairs = Slice(own_words, np.stack(sums)), Slice(own_pairs, pair_total[None, :])
        own_contexts = np.unique(own_pairs >> SHIFT)
        if hot:
            stats = {r["part"]: np.array([r["c"], r["n1"], r["n2"], r["n3"]]) for r in totals["hot"] or ()}
            for own in parts.values():
                together = sum((stats[p] for p in set(own) if p in stats), np.zeros(4, np.int64))
                for p in own:
                    at = np.searchsorted(own_contexts, U(p))
                    if at < len(own_contexts) and own_contexts[at] == U(p):
                        contexts[:, at] = together
        contexts = Slice(own_contexts, contexts)
        total, kinds = word_sizes[0], word_sizes[1]
        d, e = discounts(pair_sizes[2:6]), discounts(ends_sizes[2:6])
        many = ends_sizes[0]
        seen = np.array([ends_sizes[2], ends_sizes[3], ends_sizes[1] - ends_sizes[2] - ends_sizes[3]])
        rest = float(seen @ e[1:]) / many if many else 1.0
        n_tokens, n_known, base, score = [], [], [], []
        for a, b, t, pair, at, number in kinds_of:
            c, k = words.of(t.words()[at])
            (both,), (after, n1, n2, n3) = pairs.of(pair), contexts.of(pair >> SHIFT)
            lower = (np.maximum(k - e[np.minimum(k, 3)], 0) / many if many else 0.0) + rest / (kinds + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(after > 0, np.maximum(both - d[np.minimum(both, 3)], 0) / after + (d[1] * n1 + d[2] * n2 + d[3] * n3) / after * lower, lower)
            of_doc = lambda x: np.bincount(t.doc, weights=x, minlength=b - a)  # noqa: B023, E731
            n_tokens.append(of_doc(None))
            n_known.append(of_doc((c > 0)[number]))
            base.append(of_doc((np.log10(c + 1.0) - np.log10(float(total + kinds + 1)))[number]))
            score.append(of_doc(np.log10(p)[number]))
        columns = [table["id"], pa.array([not x for x in table["train"].to_pylist()]), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (n_tokens, n_known)), pa.array([total] * table.num_rows, pa.int64()), *(pa.array(np.concatenate(x)) for x in (base, score))]
        return pa.table(columns, schema=_SCORED)

    started = COUNTED + ", start long"
    sent_words = blocks.groupBy("block").applyInArrow(send("words"), started)
    sent_pairs = blocks.groupBy("block").applyInArrow(send("pairs"), started)
    words = sent_words.groupBy("owner").applyInArrow(_words_answer, ANSWER)
    pairs = sent_pairs.groupBy("owner").applyInArrow(_pairs_answer(hot_parts), ANSWER)
    sent_ends = blocks.groupBy("block").cogroup(pairs.select("block", "owner", "n", "values", "extra").groupBy("block")).applyInArrow(continuations, started)
    ends = sent_ends.groupBy("owner").applyInArrow(_words_answer, ANSWER)
    every = words.withColumn("level", F.lit(1)).unionByName(pairs.withColumn("level", F.lit(2))).unionByName(ends.withColumn("level", F.lit(3)))
    # Sums over the owners' shares, of which each block gets a row.
    size = lambda level, i: F.coalesce(F.sum(F.when(F.col("level") == level, F.element_at("sizes", i + 1))), F.lit(0)).cast("long")
    sizes = lambda level: F.array(*[size(level, i) for i in range(6)])
    totals = every.where("sizes is not null").agg(F.struct(sizes(1).alias("words"), sizes(2).alias("pairs"), sizes(3).alias("ends"), F.flatten(F.collect_list("hot")).alias("hot")).alias("totals"))
    totals = totals.select(F.explode(F.split(F.lit(",".join(map(str, keys))), ",").cast("array<bigint>")).alias("block"), F.lit(0).alias("level"), "totals")
    answers = every.select("block", "owner", "n", "values", "extra", "level").unionByName(totals, allowMissingColumns=True)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)


SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _with_start(table: pa.Table, keys: np.ndarray, n: int) -> pa.Table:
    """Adds the first context part of each owner of pairs."""
    starts = {int(k): ((i * (1 << PAIR)) // n) >> ex.ALIGN for i, k in enumerate(keys)}
    return table.append_column("start", pa.array([starts[o] for o in table["owner"].to_pylist()], pa.int64()))
