"""Quality rules as weak supervision.

Every rule votes good, bad or abstains. Spark counts the vote patterns of the whole corpus (a partial
aggregate over at most 3^rules patterns), expectation-maximisation over those counts estimates each
rule's accuracy and the share of good documents, and a document is kept when its posterior probability
of being good reaches the threshold. Measuring a text is one pass; what follows reads narrow rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialized, row_hash, slices, utf8

SYMBOLS = b"#*$%&|<>"
#: Marks that may stand before and after a plain word, and what may not stand inside it.
AROUND = b"\"'()[]{}.,;:!?-"
NOT_INSIDE = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in "-'")
WINDOW = 8
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_letter_words", "n_plain_words", "n_loud", "n_distinct_words", "top_word")
_SCHEMA = "doc long, rid long, " + ", ".join(f"{c} long" for c in _LONGS)

_rng = np.random.default_rng(7)
_MIX = _rng.integers(0, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of eight that the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        w += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * _MIX[j]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(w, twice)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(hit), 1)
    np.add.at(marks, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The counts named in _LONGS of one whole text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    capital = letters = plain = 0
    for w, k in counts.items():
        if w.isalpha():
            letters += k
            plain += k
            capital += k * w.isupper()
            continue
        core = w.strip(AROUND)
        plain += k * (core != b"" and len(core.translate(None, NOT_INSIDE)) == len(core))
        if not w.isascii() or w.translate(None, SYMBOLS + b"0123456789!?.,;:'\"()[]{}-_/=+@~^`\\"):
            letters += k
            capital += k * w.isupper()
    return (
        n, chars, sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeat_words(words), len(lines),
        capital, letters, plain, text.count(b"!") + text.count(b"?"), len(counts), max(counts.values(), default=0),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rid, counts) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([measure(text) for text in batch.column(2).to_pylist()], np.int64).reshape(-1, len(_LONGS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, i].copy()) for i in range(len(_LONGS)))], names=["doc", "rid", *_LONGS])

    return docs.select(F.col(id_col).cast("long").alias("doc"), row_hash(F.col(text_col)).alias("rid"), utf8(F.col(text_col)).alias("text_bytes")).mapInArrow(run, _SCHEMA)


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) where `good` holds, 0 (bad) where `bad` holds, abstains (2) elsewhere and where null."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, 0).when(self.good, 1).otherwise(2)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> list[Rule]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))

    def share(rule: str, count: str, of: Column, good: float, bad: float) -> Rule:
        return Rule(rule, F.col(count) <= good * of, F.col(count) > bad * of)

    return [
        share("symbols", "n_symbols", words, 0.05, 0.2),
        Rule("plain words", F.col("n_plain_words") >= 0.8 * words, F.col("n_plain_words") < 0.6 * words),
        share("capitals", "n_capital_words", words, 0.2, 0.5),
        share("loud marks", "n_loud", words, 0.05, 0.2),
        share("repeated words", "n_repeat_words", words, 0.1, 0.2),
        share("repeated lines", "n_dup_lines", lines, 0.2, 0.5),
        Rule("words with letters", F.col("n_letter_words") >= 0.8 * words, F.col("n_letter_words") < 0.65 * words),
        Rule("word length", F.col("word_chars").between(2.5 * words, 9 * words), (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 12 * words)),
        Rule("vocabulary", F.col("top_word") <= 0.15 * words, (F.col("top_word") > 0.3 * words) & (F.col("n_words") >= 20)),
    ]


@dataclass
class LabelModel:
    """Prior of a good document, and each rule's share of right votes among good and bad documents."""

    prior: float
    good_right: np.ndarray
    bad_right: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good for rows of votes (0 bad, 1 good, 2 abstains)."""
        up, down = votes == 1, votes == 0
        log_good = np.log(self.prior) + up @ np.log(self.good_right) + down @ np.log1p(-self.good_right)
        log_bad = np.log1p(-self.prior) + down @ np.log(self.bad_right) + up @ np.log1p(-self.bad_right)
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))


def fit(votes: np.ndarray, counts: np.ndarray, steps: int = 100) -> LabelModel:
    """EM over distinct vote patterns and their counts.

    Votes are independent given the label. Starts from the majority of votes; pseudo-counts keep rates
    inside (0.5, 1) for good documents, since a rule that is worse than a coin is no rule, and inside (0, 1) for bad ones, where a rule may see one kind of fault only.
    """
    up, down = (votes == 1).astype(float), (votes == 0).astype(float)
    q = np.where(down.sum(1) == 0, 0.9, 0.1)  # any complaint makes a document suspect at first
    model = LabelModel(0.5, np.full(votes.shape[1], 0.9), np.full(votes.shape[1], 0.5))
    for _ in range(steps):
        good, bad = counts * q, counts * (1 - q)
        model.prior = float(np.clip((good.sum() + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        model.good_right = np.clip((good @ up + 9) / (good @ (up + down) + 10), 0.5, 1 - 1e-4)
        model.bad_right = np.clip((bad @ down + 1) / (bad @ (up + down) + 4), 1e-4, 1 - 1e-4)
        new = model.posterior(votes)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, quality (the posterior) and kept for every row of docs.

    A document that fails the base rules is not kept and takes no part in the estimate. An empty table
    gives no rows. Rows of one id with different texts are judged each; rid tells them apart.
    """
    own = rules()
    base = len(own)
    pattern = sum((rule.vote() * (3**i) for i, rule in enumerate(own)), F.lit(0)).cast("int")
    counted = materialized(measured(docs, id_col, text_col)).withColumn("base_failed", base_failed()).withColumn("pattern", pattern)
    seen = counted.where(~F.col("base_failed")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3^rules rows
    codes = np.array([r.pattern for r in seen], np.int64)
    votes = codes[:, None] // 3 ** np.arange(base)[None, :] % 3
    model = fit(votes, np.array([r.n for r in seen], float)) if seen else LabelModel(0.5, np.full(base, 0.9), np.full(base, 0.5))
    table = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, model.posterior(votes) if seen else [])], "pattern int, quality double")
    return (
        counted.join(F.broadcast(table), "pattern", "left")  # at most 3^rules rows
        .withColumn("quality", F.when(~F.col("base_failed"), F.col("quality")))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= threshold, F.lit(False)))
        .drop("pattern")
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns."""
    doc, rid = fresh(docs, "doc"), fresh(docs, "rid")
    good = verdicts(docs, id_col, text_col, threshold).where("kept").select(F.col("doc").alias(doc), F.col("rid").alias(rid)).distinct()
    on = docs[id_col].cast("long").eqNullSafe(F.col(doc)) & (row_hash(docs[text_col]) == F.col(rid))
    return docs.join(good, on, "left_semi")
