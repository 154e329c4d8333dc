"""Operator 3: language identification by rank-order n-gram profiles.

A profile is a ranking of the most frequent character n-grams (one to three letters, a word's
edge counting as a letter). A document's profile is held against each language's; the distance
is the sum of how far each n-gram is out of its place, an n-gram that the language's profile
lacks being as far out as can be. The nearest language wins, ties going to the first by name.

Profiles are learned from all labelled rows that are not held out. Texts to be judged are read
whole. A text is in no known language if its nearness to every profile is under a bound that the
same rows teach: KNOWN_SHARE of what all but KNOWN_LEAST of their texts reach, and KNOWN_MOST at
most, as a few texts are near to their own profiles. Null texts and texts without a letter are `und`, score 0, and so is all if nothing was
learned. Null languages teach nothing; a null key counts as the empty text in the split.
Repeated rows are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import held_out

UNKNOWN = "und"
#: n-grams in a profile.
PROFILE = 400
#: The bound of nearness: see above.
KNOWN_SHARE, KNOWN_LEAST, KNOWN_MOST = 0.8, 0.001, 0.35


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text's n-grams in ascending order, and how often each occurs.

    A code holds up to three code points of 21 bits each, a space standing for a word's edge.
    """
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(letters()[points], points, 32).astype(np.int64)
    edge = points == 32
    if edge.all():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (points[:-1] << 21) | points[1:]
    codes = np.concatenate([points[~edge], two[~(edge[:-1] & edge[1:])], ((two[:-1] << 21) | points[2:])[~edge[1:-1]]])
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The learned languages, and the judgement of a text."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(ranks), size
        self.tables = []
        for name in self.names:
            codes = np.asarray(ranks[name], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        place = np.arange(len(profile))
        out = []
        for codes, rank in self.tables:
            at = np.minimum(np.searchsorted(codes, profile), len(codes) - 1)
            far = np.where(codes[at] == profile, np.abs(rank[at] - place), self.size)
            out.append(far.sum() / (self.size * len(profile)))
        return np.asarray(out)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and nearness (1: the language's own ranking, 0: nothing in common)."""
        profile = ranked(*gram_counts(text), self.size)
        if not len(profile) or not self.names:
            return UNKNOWN, 0.0, 0.0
        near = 1 - self.distances(profile)
        best = int(near.argmax())
        share = near**8
        return self.names[best], float(share[best] / share.sum()) if share[best] > 0 else 0.0, float(near[best])


def labelled(rows: DataFrame) -> DataFrame:
    """(lang, text): the rows that teach."""
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def learn(taught: DataFrame, *, size: int = PROFILE) -> Profiles:
    """Profiles of the languages of all rows (lang, text).

    Counts are added up in the tasks first and by n-gram next; at most languages times size
    n-grams come to the driver.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def merged(parts: list) -> list:
            codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return [(codes, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64))]

        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                parts = held.setdefault(lang, [])
                parts.append(gram_counts(text))
                if len(parts) >= 64:
                    held[lang] = merged(parts)
        for lang, parts in held.items():
            for codes, counts in merged(parts):
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    counts = taught.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("place", place).where(F.col("place") <= size)
    ranks: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["place"])):
        ranks.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranks, size)


def least_nearness(taught: DataFrame, model) -> float:
    """The nearness under which a text is in no language of the model, a broadcast one."""

    @F.pandas_udf("double")
    def near(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.value.judge(t)[2])

    found = taught.select(near("text").alias("near")).where("near > 0").agg(F.percentile_approx("near", KNOWN_LEAST, 10_000)).first()[0]
    return 0.0 if found is None else min(KNOWN_MOST, KNOWN_SHARE * found)


def identify(df: DataFrame, *, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, nearness) of each row; held-out rows teach nothing."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = held_out(F.col("doc_id"), modulus, remainder)
    model = df.sparkSession.sparkContext.broadcast(learn(labelled(rows.where(~out))))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [model.value.judge(t.as_py()) for t in batch.column("text")]
            names, scores, near = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(near, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "nearness"])

    kind = df.schema[id_col].dataType.simpleString()
    judged = rows.select("doc_id", out.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, nearness double")
    return judged.withColumnRenamed("doc_id", id_col)


def keep_known(df: DataFrame, *, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df, whole, whose text is in some learned language; map-only once learned.

    Texts that are null, or without a letter, or no nearer to any profile than the bound, go; all go
    if nothing was learned.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    taught = labelled(rows.where(~held_out(F.col("doc_id"), modulus, remainder)))
    model = df.sparkSession.sparkContext.broadcast(learn(taught))
    least = least_nearness(taught, model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.value.judge(t)[2] > least)

    return df.where(known(F.col(text_col)))
