"""Document quality by weak supervision.

Rules look at one text each and vote for or against it, or abstain. Expectation-maximisation over the
votes of all documents estimates, without labels, how often each rule is right. Junk comes in kinds, and
most rules speak for any one kind, so a document is taken to be good or of one kind of bad per rule, and
accuracies are estimated for each; the kinds start from the documents that their rule votes against. The
posterior probability of being good replaces the demand that a document pass every rule. Abstaining says
nothing about a document.

The votes are first counted by pattern, of which there are at most 3^7, so that estimation works on a
table of bounded size; a document's odds are then sums over its own votes.

Only DataFrame functions touch the rows. Windows of words are compared by 64-bit hash within one text.

Nulls: a null text has no words and fails. Null ids are passed on. Repeated rows are judged each. An empty
table gives no rows. Columns of the input are never read but for the text.
"""

from __future__ import annotations

from math import log, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import BLANKS, free_prefix, stored

WINDOW = 8
LEAST_WORDS = 20
SYMBOLS = r"[#*$%&|<>]"
ROUNDS = 50
# No rule is certain, nor is the share of good documents.
CERTAIN = 0.99
WORD = BLANKS.replace("[", "[^", 1)


def with_features(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a struct of counts over the whole text under the given name."""
    own = docs.columns
    at = {k: f"{name}_{k}" for k in ("text", "words", "hash", "sorted", "met")}
    t, w, h, s, m = (F.col(f"`{at[k]}`") for k in ("text", "words", "hash", "sorted", "met"))
    rows = docs.withColumn(at["text"], F.coalesce(F.col("text"), F.lit("")))
    trimmed = F.regexp_replace(t, f"^{BLANKS}+|{BLANKS}+$", "")
    rows = rows.withColumn(
        at["words"], F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANKS}+"))
    )
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    rows = rows.withColumn(at["hash"], F.when(F.size(w) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn(at["sorted"], F.when(F.size(F.array_distinct(h)) < F.size(h), by_hash))
    twice = F.filter(s, lambda p, i: (F.get(s, i - 1)["x"] == p["x"]) | (F.get(s, i + 1)["x"] == p["x"]))
    starts = F.array_sort(F.transform(twice, lambda p: p["i"]))
    rows = rows.withColumn(at["met"], starts)
    # Words from each start on that no earlier window has covered.
    covered = F.aggregate(
        m,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
    count = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.regexp_replace(t, f"{BLANKS}+", "")),
        "n_symbols": F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(lines),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_shouted": F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1))),
        "n_lettered": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
    }
    return rows.select(*[docs[c] for c in own], F.struct(*[v.cast("long").alias(k) for k, v in count.items()]).alias(name))


def votes(f: Column) -> list[Column]:
    """One vote per rule: 1 for, -1 against, 0 abstains."""
    n = F.greatest(f["n_words"], F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    mean = f["word_chars"] / n
    rich = f["n_distinct"] / F.sqrt(n)
    several = f["n_lines"] > 1
    return [
        vote(mean.between(3.5, 6.5), ~mean.between(2.5, 10.0)),
        vote(f["n_symbols"] <= 0.01 * n, f["n_symbols"] > 0.1 * n),
        vote(several & (f["n_dup_lines"] == 0), several & (f["n_dup_lines"] > 0.3 * f["n_lines"])),
        vote(f["n_repeat_words"] <= 0.05 * n, f["n_repeat_words"] > 0.3 * n),
        vote(rich >= 4.0, rich < 2.5),
        vote(f["n_shouted"] <= 0.1 * n, f["n_shouted"] > 0.5 * n),
        vote(f["n_lettered"] >= 0.9 * n, f["n_lettered"] < 0.7 * n),
    ]


def base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


Model = tuple[list[float], list[list[float]]]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """Share of each class, good ones first, and how often each rule votes for each, if it votes.

    From rows (votes, number of documents). At the start a document is rather good if no rule votes
    against it, else rather of the kinds whose rules do.
    """
    rules = len(patterns[0][0]) if patterns else 0
    belief = []
    for v, _ in patterns:
        against = [j for j in range(rules) if v[j] < 0]
        good = 0.1 if against else 0.9
        rest = (1 - good) / (len(against) or rules)
        belief.append([good, *(rest * (j in against or not against) for j in range(rules))])
    model: Model = ([1.0], [[0.5] * rules])
    for _ in range(ROUNDS if patterns else 0):
        mass = [[p * n for p in b] for b, (_, n) in zip(belief, patterns, strict=True)]
        sums = [sum(m[k] for m in mass) for k in range(rules + 1)]
        share = [max(x, 1e-9) / sum(sums) for x in sums]
        favour = []
        for k in range(rules + 1):
            row = []
            for j in range(rules):
                said = sum(m[k] for m, (v, _) in zip(mass, patterns, strict=True) if v[j])
                up = sum(m[k] for m, (v, _) in zip(mass, patterns, strict=True) if v[j] > 0)
                row.append(min(CERTAIN, max(1 - CERTAIN, up / said)) if said > 1e-9 else 0.5)
            favour.append(row)
        model = share, favour
        belief = [classes(model, v) for v, _ in patterns]
    return model


def classes(model: Model, vote: tuple[int, ...]) -> list[float]:
    """Posterior of every class under these votes."""
    weight = [
        share * prod(f if v > 0 else 1 - f for f, v in zip(row, vote, strict=True) if v)
        for share, row in zip(*model, strict=True)
    ]
    return [w / sum(weight) for w in weight]


def verdict(features: DataFrame, name: str, least: float = 0.5) -> Column:
    """Whether a row's posterior reaches `least`. Features must be stored: the votes of all are counted."""
    columns = votes(F.col(name))
    counted = features.select(*[v.alias(f"v{j}") for j, v in enumerate(columns)])
    rows = counted.groupBy(*counted.columns).agg(F.count("*").alias("n")).collect()  # at most 3^7
    if not rows:
        return F.lit(False)
    share, favour = estimate(sorted((tuple(r)[:-1], r["n"]) for r in rows))
    weight = []
    for part, row in zip(share, favour, strict=True):
        odds = F.lit(log(part))
        for column, f in zip(columns, row, strict=True):
            odds = odds + F.when(column > 0, log(f)).when(column < 0, log(1 - f)).otherwise(0.0)
        weight.append(F.exp(odds))
    return weight[0] >= least * sum(weight[1:], weight[0])


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    features = stored(with_features(docs.select("doc_id", "text"), "counts").drop("text"), "quality")
    kept = verdict(features, "counts", least)
    bad = base_failed(F.col("counts"))
    return features.select("doc_id", "counts.*", bad.alias("base_failed"), (~bad & kept).alias("kept"))


def good_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they came, that pass the base and reach the posterior."""
    name = free_prefix(docs.columns, "counts")
    features = stored(with_features(docs, name), "quality")
    return features.where(~base_failed(F.col(name)) & verdict(features, name, least)).select(*docs.columns)
