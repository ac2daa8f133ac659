"""Scores of a hashed maximum-entropy language model (operator 10).

P(token | history) = P(group | history) P(class | group, history) P(token | class). The first two factors are softmaxes over 16
groups and 16 classes in each; their features are hashed: a bias, the previous token, the token before it (a skip), and the pair.
The ``OWN`` most frequent tokens are classes of their own; the others fall into classes by spelling, where the last factor is a
smoothed relative count. In histories, tokens beyond the ``UNITS`` most frequent stand for their spelling class.

Counts cover all training tokens: a count of every distinct token stays a distributed table. What is broadcast has a fixed
bound: the ``TOP`` most frequent tokens (by a count threshold, so never more), and the weights. A text's tokens beyond them
meet their counts in a join, and are rare by construction, so no key of that join is hot.

Training takes ``ROUNDS`` rounds; a training document belongs to one of them. In a round every partition runs gradient steps over
its documents from the shared weights and sends, for the weight rows it touched, its change; changes are averaged row by row,
weighted by the tokens behind them. Scoring is one pass in numpy over batches of texts.

Defined cases: a null text is empty and has the end token only; an empty training set leaves N = 0 and V = 0, so that the base is
log10(0.1 / 0.1) = 0; repeated rows count as often as they occur; a null id has the empty text as its checksum's input;
other columns pass through.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import keep

SIDE = 16
SPELLINGS = 32
OWN = SIDE * SIDE - SPELLINGS
UNITS = 4096
TOP = 1 << 18
PAIRS = 1 << 15
ALPHA = 0.1
ROUNDS = 2
RATE = 0.4
STEP_TOKENS = 4096
BLOCK = 256
CACHE_WORDS = 300_000
BATCH_CHARS = 1_000_000
END = b"\x00end"

PAD = UNITS + SPELLINGS
WIDTH = PAD + 1
ROWS_1 = 1 + 2 * WIDTH + PAIRS
ROWS_2 = SIDE * (1 + 2 * WIDTH)
ROWS = ROWS_1 + ROWS_2
FIGURE, SYMBOL, FOREIGN = (re.compile(x).search for x in (rb"[0-9]", rb"[#*$%&|<>]", rb"[\x80-\xff]"))
STOPS = tuple(bytes([c]) for c in b".,;:!?")


def token_hash(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def spelling(token: bytes) -> int:
    """The spelling class: figures, symbols, or by the first letter outside ASCII, a final stop and the length."""
    if token.isalpha():
        return 4 + (len(token) > 5)
    if token == END:
        return 0
    if FIGURE(token):
        return 1
    if SYMBOL(token):
        return 2 if len(token) < 3 else 3
    foreign = FOREIGN(token)
    at = foreign.start() if foreign else -1
    letter = 0 if at < 0 else 1 + (token[at] * 31 + token[min(at + 1, len(token) - 1)]) % 5
    return 4 + letter * 4 + 2 * token.endswith(STOPS) + (len(token) > 5)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, tokens of each text) in pieces; A-Z are lowered, tokens are divided by ASCII white space and end with the end."""
    for batch in batches:
        ids, tokens, chars = [], [], 0
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                tokens.append([*(t or "").encode().lower().split(), END])
                chars += len(t or "")
            if chars > BATCH_CHARS:
                yield ids, tokens
                ids, tokens, chars = [], [], 0
        if ids:
            yield ids, tokens


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, spelling, n), summed within pieces of the partition."""
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        names = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([token_hash(w) for w in names], pa.int64()), pa.array([spelling(w) for w in names], pa.int32()),
                                           pa.array([counts[w] for w in names], pa.int64())], ["token", "spelling", "n"])

    for _, texts in texts_of(batches):
        for tokens in texts:
            counts.update(tokens)
        if len(counts) > CACHE_WORDS:
            yield out()
            counts.clear()
    if counts:
        yield out()


class Lexicon(NamedTuple):
    """What scoring and training know of the tokens; of a fixed size at most."""

    hashes: np.ndarray  # of the most frequent tokens, sorted
    counts: np.ndarray
    ranks: np.ndarray
    class_cost: np.ndarray  # log10 of a class's tokens with smoothing; 0 for a token's own class
    total: int
    distinct: int
    class_counts: np.ndarray


class Coder:
    """Codes of tokens, worked out once for each distinct token and forgotten beyond CACHE_WORDS of them."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.numbers = lexicon, {}
        self.codes = np.empty((0, 4), np.int64)

    def look_up(self, tokens: list[bytes]) -> np.ndarray:
        """Rows of (unit in histories, class, count or -1 where it is not among the most frequent, hash)."""
        x = self.lexicon
        h = np.array([token_hash(w) for w in tokens], np.int64)
        s = np.array([spelling(w) for w in tokens], np.int64)
        k = np.minimum(np.searchsorted(x.hashes, h), max(0, len(x.hashes) - 1))
        found = x.hashes[k] == h if len(x.hashes) else np.zeros(len(h), bool)
        rank = np.where(found, x.ranks[k], UNITS) if len(x.hashes) else np.full(len(h), UNITS)
        n = np.where(found, x.counts[k], -1) if len(x.hashes) else np.full(len(h), -1)
        return np.stack([np.where(rank < UNITS, rank, UNITS + s), np.where(rank < OWN, rank, OWN + s), n, h], 1)

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """Rows for all tokens of all texts, in order."""
        if len(self.numbers) > CACHE_WORDS:
            self.numbers, self.codes = {}, self.codes[:0]
        numbers, known = self.numbers, len(self.numbers)
        at = np.array([numbers.setdefault(w, len(numbers)) for tokens in texts for w in tokens], np.int64)
        if len(numbers) > known:
            fresh = list(itertools.islice(numbers, known, None))
            self.codes = np.concatenate([self.codes[:known], self.look_up(fresh)])
        return self.codes[at]


def history_rows(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of the weights that the history of each token points to: (bias, previous, skip, pair)."""
    one = np.empty_like(units)
    one[1:], one[starts] = units[:-1], PAD
    two = np.empty_like(units)
    two[1:], two[starts] = one[:-1], PAD
    pair = ((one * 1_000_003 + two) * 0x9E3779B1 >> 11) % PAIRS
    return np.stack([np.zeros_like(one), 1 + one, 1 + WIDTH + two, 1 + 2 * WIDTH + pair])


def inner_rows(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    return ROWS_1 + group * (1 + 2 * WIDTH) + rows[:3]


def softmax(weights: np.ndarray, rows: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log chance of the outcome, chances of all outcomes) for the sum of the weight rows of each token."""
    x = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        x += weights.take(r, axis=0)
    x -= np.maximum.reduce(np.ascontiguousarray(x.T))[:, None]
    seen = x[np.arange(len(outcome)), outcome]
    np.exp(x, out=x)
    total = x @ np.ones(SIDE, np.float32)
    x *= (1 / total)[:, None]
    return seen - np.log(total), x


def chances(weights: np.ndarray, rows: np.ndarray, target: np.ndarray):
    """For each of the two softmaxes: the rows used, the outcome, its log chance and all chances."""
    group = target // SIDE
    inner = inner_rows(rows, group)
    return tuple((r, y, *softmax(weights, r, y)) for r, y in ((rows, group), (inner, target % SIDE)))


def start_weights(lexicon: Lexicon) -> np.ndarray:
    """Zero but for the biases, which give classes their relative counts."""
    weights = np.zeros((ROWS, SIDE), np.float32)
    table = lexicon.class_counts.reshape(SIDE, SIDE) + ALPHA
    weights[0] = np.log(table.sum(1))
    weights[ROWS_1 + np.arange(SIDE) * (1 + 2 * WIDTH)] = np.log(table)
    return weights


def gradient_step(weights: np.ndarray, touched: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One step on a batch: every row moves by the mean gradient of the tokens that point to it."""
    n = len(target)
    for used, outcome, _, slope in chances(weights, rows, target):
        np.negative(slope, out=slope)
        slope[np.arange(n), outcome] += 1
        # Row and token in one number: sorting brings the tokens of a row together.
        order = np.sort((used * n + np.arange(n)).ravel())
        row = order // n
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sums = np.add.reduceat(slope.take(order - row * n, axis=0), first, axis=0)
        size, which = np.diff(np.r_[first, len(order)]).astype(np.float32), row[first]
        weights[which] = weights.take(which, axis=0) + sums * (np.float32(RATE) / size)[:, None]
        touched[which] += size


def batches_of_codes(batches, coder: Coder):
    """(ids, starts of the texts, units, classes, counts, hashes) as arrays over the tokens of several texts."""
    for ids, texts in texts_of(batches):
        codes = coder.of(texts)
        starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
        yield ids, starts, codes[:, 0], codes[:, 1], codes[:, 2], codes[:, 3]


def trainer(shared, lexicon):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        weights, touched, coder = base.copy(), np.zeros(ROWS, np.float32), Coder(lexicon.value)
        for _, starts, units, classes, _, _ in batches_of_codes(batches, coder):
            rows = history_rows(units, starts)
            for k in range(0, len(units), STEP_TOKENS):
                gradient_step(weights, touched, rows[:, k:k + STEP_TOKENS], classes[k:k + STEP_TOKENS])
        for k in range(0, ROWS, BLOCK):
            n = touched[k:k + BLOCK]
            if n.any():
                change = np.concatenate([(weights[k:k + BLOCK] - base[k:k + BLOCK]) * n[:, None], n[:, None]], 1).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([change.tobytes()], pa.binary())], ["block", "change"])

    return train


def add_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums changes by block as they stream by; a task holds its blocks once, however many changes come in."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, change in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(change.as_buffer(), "<f4").astype("f8")
            sums[block] = sums[block] + values if block in sums else values
    for block, values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.astype("<f4").tobytes()], pa.binary())], ["block", "change"])


def trained(training: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all rounds, from documents (id, text, turn)."""
    context = training.sparkSession.sparkContext
    weights, shared_lexicon = start_weights(lexicon), context.broadcast(lexicon)
    for turn in range(rounds):
        shared = context.broadcast(weights)
        schema = "block int, change binary"
        changes = training.where(F.col("turn") == turn).select("id", "text").mapInArrow(trainer(shared, shared_lexicon), schema)
        # As many rows as the weights have blocks, whatever the number of documents.
        for r in changes.repartition("block").mapInArrow(add_changes, schema).collect():
            change = np.frombuffer(r.change, "<f4").reshape(-1, SIDE + 1)
            seen = change[:, SIDE] > 0
            at = r.block * BLOCK + np.flatnonzero(seen)
            weights[at] += change[seen, :SIDE] / change[seen, SIDE:]
        shared.unpersist()
    return weights


def counted(training: DataFrame) -> DataFrame:
    """(token, spelling, n) of all training tokens, kept."""
    parts = training.select("id", "text").mapInArrow(count_tokens, "token long, spelling int, n long")
    return keep(parts.groupBy("token").agg(F.min("spelling").alias("spelling"), F.sum("n").alias("n")), "token-counts")


def build_lexicon(counts: DataFrame, top: int = TOP) -> Lexicon:
    """Collects tables of a fixed size: counts of counts down to a threshold, the tokens above it, the classes' sums."""
    levels = counts.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).limit(top).collect()
    least, room = None, top
    for r in levels:
        room -= r.tokens
        if room < 0:
            break
        least = r.n
    frequent = counts.where(F.col("n") >= (least if least is not None else 1 << 62)).toPandas().sort_values(["n", "token"], ascending=[False, True])
    hashes, n = frequent["token"].to_numpy("i8"), frequent["n"].to_numpy("i8")
    sums = counts.groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("tokens")).collect()
    class_counts, kinds = np.zeros(SIDE * SIDE), np.zeros(SPELLINGS)
    for r in sums:
        class_counts[OWN + r.spelling], kinds[r.spelling] = r.n, r.tokens
    own = min(OWN, len(n))
    class_counts[:own] = n[:own]
    spell = frequent["spelling"].to_numpy("i8")[:own]
    np.subtract.at(class_counts, OWN + spell, n[:own])
    np.subtract.at(kinds, spell, 1)
    cost = np.zeros(SIDE * SIDE)
    cost[OWN:] = np.log10(class_counts[OWN:] + ALPHA * (kinds + 1))
    order = np.argsort(hashes)
    return Lexicon(hashes[order], n[order], np.arange(len(n))[order], cost, sum(r.n for r in sums), sum(r.tokens for r in sums), class_counts)


SCORED = "row long, id long, n_tokens long, n_known long, log_counts double, class_counts double, log_classes double, rare array<long>"


def scorer(shared, shared_lexicon):
    """Per text: what the frequent tokens add to its scores, and its other tokens."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lexicon = shared.value, shared_lexicon.value
        coder, row = Coder(lexicon), TaskContext.get().partitionId() << 40
        for ids, starts, units, classes, n, hashes in batches_of_codes(batches, coder):
            logs = np.empty(len(units))
            rows = history_rows(units, starts)
            for k in range(0, len(units), STEP_TOKENS):
                part = slice(k, k + STEP_TOKENS)
                logs[part] = sum(x.astype("f8") for _, _, x, _ in chances(weights, rows[:, part], classes[part]))
            logs = logs / np.log(10) - lexicon.class_cost[classes]
            known = n >= 0
            smoothed = np.where(known, np.log10(np.maximum(n, 0) + ALPHA), 0.0)
            add = lambda x: np.add.reduceat(x, starts)
            rare = np.where(known, 0, 1)
            offsets = np.r_[0, np.cumsum(add(rare))].astype("i4")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array(np.diff(np.r_[starts, len(units)])), pa.array(add(known.astype("i8"))),
                pa.array(add(smoothed)), pa.array(add(np.where(classes < OWN, 0.0, smoothed))), pa.array(add(logs)),
                pa.ListArray.from_arrays(offsets, hashes[~known])],
                ["row", "id", "n_tokens", "n_known", "log_counts", "class_counts", "log_classes", "rare"])
            row += len(ids)

    return score


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = TOP, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    training = rows.where(~held_out(F.col("id"))).withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    counts = counted(training)
    lexicon = build_lexicon(counts, top)
    weights = trained(training, lexicon, rounds)
    scored = rows.mapInArrow(scorer(context.broadcast(weights), context.broadcast(lexicon)), SCORED)
    scored = keep(scored, "scores")
    rare = scored.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count("*").alias("k"))
    rare = rare.join(counts.select("token", "n"), "token", "left")
    smoothed = F.log10(F.coalesce("n", F.lit(0)).cast("double") + F.lit(ALPHA))
    rare = rare.groupBy("row").agg(F.sum(F.col("k") * smoothed).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"))
    df = scored.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    per_token = float(np.log10(lexicon.total + ALPHA * (lexicon.distinct + 1)))
    return df.select("id", held_out(F.col("id")).alias("held_out"), "n_tokens",
                     (F.col("n_known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"), F.lit(int(lexicon.total)).cast("long").alias("train_tokens"),
                     (F.col("log_counts") + more - F.col("n_tokens") * per_token).alias("base_score"),
                     (F.col("class_counts") + more + F.col("log_classes")).alias("score"))
