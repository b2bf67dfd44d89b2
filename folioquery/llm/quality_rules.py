"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0). How far a
rule can be trusted is not set by hand: expectation-maximisation over the votes of all documents
estimates for each rule how often it is right on good and on bad documents, together with the share
of good documents. The posterior probability of good quality then decides, so one failed rule
does not reject a document that the others hold for good. Documents meet the estimation only as
counts of vote patterns, of which there are at most 3**rules whatever the corpus.

Base rules are stricter: a document of fewer than 10 words, or with more than a fifth of its words in
five-word windows that repeat, is rejected without a vote.

Words are `[^\\x20\\x09-\\x0D]+`, lines end at \\n. Null counts as the empty text: no word, base rules reject
it. Equal texts have equal rows; repeated rows count as often as they stand. A very long text is
one row of arrays and never leaves its task; an empty table gives no rows. Only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.session import materialize

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEATED_PERCENT = 20  # of the words, before the base rule rejects
ROUNDS = 25
RIGHT = 0.8  # what each rule is believed to be right at first
SMOOTH = 0.01  # of all documents: weight of that belief in every round


@dataclass(frozen=True)
class Rule:
    """Conditions over the measured columns; where neither holds the rule abstains. Good is asked first."""

    name: str
    good: str
    bad: str


#: Comparisons of whole numbers only, so that every engine votes alike.
RULES = [
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_size", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("symbols", "n_symbols = 0", "10 * n_symbols > n_words"),
    Rule("same_lines", "n_lines > 1 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("same_words", "n_words >= 50 AND n_repeat_words = 0", "100 * n_repeat_words > 10 * n_words"),
    Rule("vocabulary", "n_words >= 50 AND n_words <= 2000 AND 100 * n_distinct > 35 * n_words", "n_words <= 2000 AND 100 * n_distinct < 20 * n_words"),
    Rule("sentences", "2 * n_closed >= n_lines AND n_lines > 0", "10 * n_closed < n_lines"),
    Rule("letters", "10 * n_letters >= 8 * word_chars AND word_chars > 0", "10 * n_letters < 6 * word_chars"),
]


def _repeated(pairs: Column) -> Column:
    """Positions of sorted (key, position) pairs whose key a neighbour shares; the array must be a stored column."""
    size = F.size(pairs)
    same = lambda a, b: F.coalesce(F.get(pairs, a)["key"] == F.get(pairs, b)["key"], F.lit(False))
    marked = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get(pairs, i)["position"]),
    )
    return F.when(size > 1, F.array_compact(marked)).otherwise(F.array().cast("array<int>"))


def _starts(n_words: str) -> Column:
    """First words of all windows, from 0; for texts of more than one window only."""
    return F.sequence(F.lit(0), F.col(n_words) - WINDOW)


def measure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id and the counts that the rules look at, as longs.

    Windows are compared by a hash first. Only where hashes repeat the words of these windows are
    compared themselves, so hash collisions cost time and change nothing.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "words",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).alias("n_letters"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"[.!?\x{2026}][\x20\x09-\x0D]*\z"))).alias("n_closed"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.transform(_starts("n"), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))
    hashed = counted.withColumn("windows", F.when(F.col("n") > WINDOW, windows)).drop("hashes")
    # Most texts end here: no hash of a window comes twice.
    repeats = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    pairs = F.transform("windows", lambda key, i: F.struct(key.alias("key"), i.alias("position")))
    sorted_ = hashed.withColumn("pairs", F.when(repeats, F.array_sort(pairs))).drop("windows")
    candidates = sorted_.withColumn("maybe", F.when(F.col("pairs").isNotNull(), _repeated(F.col("pairs")))).drop("pairs")
    spelled = F.transform(
        "maybe", lambda i: F.struct(F.array_join(F.slice("words", i + 1, F.lit(WINDOW)), " ").alias("key"), i.alias("position"))
    )
    compared = candidates.withColumn("pairs", F.when(F.col("maybe").isNotNull(), F.array_sort(spelled))).drop("maybe", "words")
    found = compared.withColumn("at", F.when(F.col("pairs").isNotNull(), F.array_sort(_repeated(F.col("pairs"))))).drop("pairs")
    # A window covers its words up to the next window that repeats.
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda total, own: total + own,
    )
    longs = ["word_chars", "n_symbols", "n_dup_lines", "n_letters", "n_lines", "n_closed", "n_distinct"]
    return found.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *(F.col(c).cast("long").alias(c) for c in longs),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.good), 1).when(F.expr(rule.bad), -1).otherwise(0)


@dataclass(frozen=True)
class Trust:
    """Share of good documents, and of each rule how often its vote is right on good and on bad ones."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def posterior(votes: Column, trust: Trust) -> Column:
    """Probability of good quality, given the array of votes."""
    weights = zip(trust.on_good, trust.on_bad, strict=True)
    for_good, against = zip(*((log(a / (1 - b)), log((1 - a) / b)) for a, b in weights), strict=True)
    # The numbers go in as two constant arrays, so that every round runs the same compiled code.
    own = F.transform(
        votes,
        lambda vote, i: F.when(vote == 1, F.get(F.lit([*for_good]), i)).when(vote == -1, F.get(F.lit([*against]), i)).otherwise(0.0),
    )
    odds = F.aggregate(own, F.element_at(F.lit([log(trust.good / (1 - trust.good))]), 1), lambda total, x: total + x)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: int, rounds: int = ROUNDS, right: float = RIGHT, smooth: float = SMOOTH) -> Trust:
    """Expectation-maximisation over patterns(votes array, n); three rows per rule and round reach the driver.

    Expectation: the posterior of each pattern. Maximisation: weighted shares of right votes among the votes
    that are no abstention, drawn to `right` by the weight of a share `smooth` of all documents, which also
    keeps every estimate away from 0 and 1.
    """
    trust = Trust(0.5, (right,) * rules, (right,) * rules)
    total = patterns.agg(F.sum("n")).first()[0]
    if not total:
        return trust
    belief = smooth * total
    for _ in range(rounds):
        good = F.col("n") * posterior(F.col("votes"), trust)
        # All documents count as one more rule, the last, that always votes.
        rated = patterns.select("n", good.alias("good"), F.posexplode(F.concat("votes", F.array(F.lit(1)))).alias("rule", "vote"))
        sums = rated.where("vote <> 0").groupBy("rule", "vote").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        held = {(r["rule"], r["vote"]): (r["good"], r["n"] - r["good"]) for r in sums.collect()}

        def share(rule: int, vote: int, bad: int) -> float:
            hits, rest = held.get((rule, vote), (0.0, 0.0))[bad], held.get((rule, -vote), (0.0, 0.0))[bad]  # noqa: B023
            return (hits + right * belief) / (hits + rest + belief)

        trust = Trust(
            (held[rules, 1][0] + 0.5 * belief) / (total + belief),
            tuple(share(i, 1, 0) for i in range(rules)),
            tuple(share(i, -1, 1) for i in range(rules)),
        )
    return trust


def rate(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability; a row per document."""
    votes = F.array(*map(vote, rules))
    voted = materialize(measure(docs).select("*", votes.alias("votes"), base_failed().alias("base_failed")), "rules-votes")
    # At most 3**rules rows, in one order, so that sums of a round are the same on every run.
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions("votes")
    probability = posterior(F.col("votes"), estimate(materialize(patterns, "rules-patterns"), len(rules)))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (probability >= 0.5)).alias("kept"),
        F.round(probability, 4).alias("probability"),
    )


def oracle_sql(rules: list[Rule] = RULES, rounds: int = ROUNDS, right: float = RIGHT, smooth: float = SMOOTH) -> str:
    """The same rows in DuckDB's SQL: windows are unnested and grouped, the rounds are a recursive query."""
    names = [rule.name for rule in rules]
    votes = ", ".join(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END AS {r.name}" for r in rules)

    def log_odds(t: str) -> str:
        terms = [f"ln({t}.good / (1 - {t}.good))"]
        for i, name in enumerate(names, start=1):
            a, b = f"{t}.a[{i}]", f"{t}.b[{i}]"
            terms.append(f"CASE {name} WHEN 1 THEN ln({a} / (1 - {b})) WHEN -1 THEN ln((1 - {a}) / {b}) ELSE 0 END")
        return " + ".join(terms)

    belief = f"{smooth} * sum(n)"
    share = lambda w, v, name: (
        f"(coalesce(sum({w}) FILTER (WHERE {name} = {v}), 0) + {right} * {belief}) / (coalesce(sum({w}) FILTER (WHERE {name} <> 0), 0) + {belief})"
    )
    return f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM documents
), spots AS (
  SELECT r, words, unnest(range(len(words))) AS p FROM split
), spans AS (
  SELECT r, p, array_to_string(words[p + 1 : p + {WINDOW}], ' ') AS span FROM spots WHERE p + {WINDOW} <= len(words)
), twice AS (
  SELECT r, p FROM spans QUALIFY count(*) OVER (PARTITION BY r, span) > 1
), covered AS (
  SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM twice, range({WINDOW}) AS w(k) GROUP BY r
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS n_letters,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '[.!?\\x{{2026}}][\\x20\\x09-\\x0D]*\\z'))) AS n_closed,
         len(list_distinct(words)) AS n_distinct, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)
), voted AS MATERIALIZED (
  SELECT *, {votes}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM measured
), patterns AS MATERIALIZED (
  SELECT {", ".join(names)}, count(*) AS n FROM voted GROUP BY ALL
), trust AS (
  SELECT 0 AS turn, 0.5::DOUBLE AS good, {[right] * len(names)}::DOUBLE[] AS a, {[right] * len(names)}::DOUBLE[] AS b
  UNION ALL
  SELECT turn + 1, (sum(g) + 0.5 * {belief}) / (sum(n) + {belief}),
         [{", ".join(share("g", 1, name) for name in names)}], [{", ".join(share("n - g", -1, name) for name in names)}]
  FROM (SELECT patterns.*, t.turn, n / (1 + exp(-({log_odds("t")}))) AS g FROM patterns, trust AS t WHERE t.turn < {rounds})
  GROUP BY turn
), rated AS (
  SELECT voted.*, 1 / (1 + exp(-({log_odds("t")}))) AS probability FROM voted, trust AS t WHERE t.turn = {rounds}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND probability >= 0.5 AS kept, round(probability, 4) AS probability
FROM rated
"""
