"""Mixing sources to target weights by soft membership; DataFrame functions only.

A classifier over hashed words, word beginnings and word endings is counted on a bounded sample of a
labelled table: a token speaks for a domain by the logarithm of its documents there over those expected, if they differ by more
than chance does, else not at all.  Sums of such weights are overconfident, as words come together; so rows of the sample that
were not counted settle how far they are to be trusted: over the sums divided by the root of the number of words a logistic
curve with a slope and a constant per domain is fitted to them by Newton's method, a step being one small aggregate.  At its optimum the mean posteriors of these rows are their labels' shares.  The curve gives
every document posterior probabilities of the domains.  Each document then gets a nonnegative rate, how often it is to be used.  With t_i words of document i, p_ik
its posteriors, D all words, s_k = sum_i t_i p_ik / D and goals b_k, the rates solve

    minimise  sum_k (sum_i r_i t_i p_ik / D - b_k)^2 / s_k + pull * sum_i t_i (r_i - 1)^2 / D,   0 <= r_i <= most,

by projected gradient steps.  A step needs one number per domain from all documents: an
aggregate over the stored posteriors.  A document's own rate is a chain of a few of these steps in one
column expression, stored with the posteriors when the chain gets long.

The goals are the targets times a total.  By default the total is the largest for which no domain has
to grow; ``total`` sets it as a part of all words.  ``most`` is the highest rate, None for no bound.
With ``whole``, that domain's goal is all its words and the other targets are ceilings in proportion to it: a domain below
its ceiling has all its words as goal, so that a scarce one does not shrink the others.

Defined cases: a null or empty text has no words; its posteriors are those of the curve's constants
and its rate is that of such a document.  Without rows to settle the curve it is taken as it stands, with the
domains' shares.  Null domains and ids
teach nothing, nor do labels without a document; an id labelled twice teaches twice.  A domain without a sampled word has posterior 0.  Without
any, or without words, every rate is 1, as it is if the domain that is to be whole has none.  Repeated rows get equal rates.  An empty table
gives an empty result.  Other columns are ignored (``mixed_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from .common import bounded_sample, fold, whole_text

BUCKETS = 1 << 15
EDGE = 5  # letters of a word's beginning and ending
CHANCE = 4.0  # standard deviations that chance explains
SETTLING = 4  # one in so many sampled rows is not counted but settles the curve
RIDGE = 1e-4
STEPS = 25
SAMPLE_ROWS = 10_000
PULL = 1e-3
ROUNDS = 60
TOLERANCE = 1e-8  # rounds end when no domain's part of all words changes by more
CHAINED = 4


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but the six ASCII white-space characters; an end may be empty."""
    return F.split(text, "[ \\t\\n\\x0B\\f\\r]+")


def word_rows(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """One row per word with the buckets of the word, its beginning and its ending; a text without words has one row with null buckets."""
    rows = docs.select(*keep, F.explode(words_of(whole_text())).alias("_word"))
    place = lambda kind, token: F.when(F.col("_word") != "", F.pmod(F.xxhash64(F.lit(kind), token), F.lit(BUCKETS)).cast("int"))
    return rows.select(*[c for c in rows.columns if c != "_word"], place("word", F.col("_word")).alias("bucket"),
                       place("beginning", F.lower(F.substring("_word", 1, EDGE))).alias("bucket2"), place("ending", F.lower(F.right("_word", F.lit(EDGE)))).alias("bucket3"))


def settling(row_id: Column | str) -> Column:
    return F.coalesce(fold(row_id, SETTLING) == 0, F.lit(False))


def sampled(labelled: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` (doc_id, domain) pairs."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select("doc_id", "domain")
    return bounded_sample(known, rows)


def word_weights(docs: DataFrame, known: DataFrame, domains: list[str]) -> DataFrame:
    """One row: per domain the weight of each bucket (``w0`` ...) and the log share of documents (``prior0`` ...)."""
    spark = docs.sparkSession
    counted = known.where(~settling("doc_id"))
    each = range(len(domains))
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("domain") == domains[k], F.col(c))), F.lit(0))
    # Documents per bucket and domain; a text counts once however often it is copied.
    texts = docs.select("doc_id", "text").join(F.broadcast(counted), "doc_id").select("text", "domain").distinct()
    rows = word_rows(texts.withColumn("_row", F.monotonically_increasing_id()), "_row", "domain")
    held = rows.select("_row", "domain", F.explode(F.array("bucket", "bucket2", "bucket3")).alias("bucket")).where("bucket is not null").distinct()
    counts = held.groupBy("bucket", "domain").count()
    grid = (spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
            .groupBy("bucket").agg(*[of(k, "count").alias(f"n{k}") for k in each]))
    rows_ = F.sort_array(F.collect_list(F.struct("bucket", *[f"n{k}" for k in each])))  # BUCKETS entries
    table = grid.agg(rows_.alias("g"), *[F.sum(f"n{k}").alias(f"t{k}") for k in each])
    shares = counted.groupBy().agg(*[F.count_if(F.col("domain") == d).alias(f"d{k}") for k, d in enumerate(domains)], F.count("*").alias("d"))
    table = table.join(shares)  # one row each
    total = sum((F.col(f"t{k}") for k in each), F.lit(0))

    def weight(k: int) -> Column:
        def one(x: Column) -> Column:
            expected = sum((x[f"n{j}"] for j in each), F.lit(0)) * F.col(f"t{k}") / total
            return F.when(F.abs(x[f"n{k}"] - expected) > CHANCE * F.sqrt(expected + 1), F.log((x[f"n{k}"] + 1) / (expected + 1))).otherwise(0.0)
        return F.when(F.col(f"t{k}") > 0, F.transform("g", one)).alias(f"w{k}")

    prior = lambda k: F.when(F.col(f"t{k}") > 0, F.log((F.col(f"d{k}") + 0.5) / (F.col("d") + 0.5 * len(domains)))).alias(f"prior{k}")
    return written(table.select(*[weight(k) for k in each], *[prior(k) for k in each]), "weights")


def weighed(docs: DataFrame, weights: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, n_words, z0, z1, ...) per row of ``docs``, stored: the sums of its words' weights over the root of their number."""
    each = range(len(domains))
    rows = word_rows(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "doc_id", "_row")
    lookup = lambda k, b: F.coalesce(F.element_at(weights.select(f"w{k}").scalar(), F.col(b) + 1), F.lit(0.0))
    summed = rows.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.count("bucket").alias("n_words"),
                                      *[F.sum(lookup(k, "bucket") + lookup(k, "bucket2") + lookup(k, "bucket3")).alias(f"z{k}") for k in each])
    size = F.sqrt(F.col("n_words") + 1.0)
    return written(summed.select("doc_id", "n_words", *[(F.coalesce(F.col(f"z{k}"), F.lit(0.0)) / size).alias(f"z{k}") for k in each]), "weighed")


def _probabilities(use: list[int], slopes: dict[int, float], constants: dict[int, float]) -> dict[int, Column]:
    score = {k: F.col(f"z{k}") * F.lit(slopes[k]) + F.lit(constants[k]) for k in use}
    top = F.greatest(*score.values()) if len(use) > 1 else score[use[0]]
    raised = {k: F.exp(x - top) for k, x in score.items()}
    total = sum(raised.values(), F.lit(0.0))
    return {k: x / total for k, x in raised.items()}


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """A small linear system by elimination with pivots."""
    rows, n = [[*r, x] for r, x in zip(a, b)], len(b)
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        if rows[i][i] == 0.0:
            continue
        for r in range(n):
            if r != i:
                part = rows[r][i] / rows[i][i]
                rows[r] = [x - part * y for x, y in zip(rows[r], rows[i])]
    return [r[-1] / r[i] if r[i] else 0.0 for i, r in enumerate(rows)]


def settled(scores: DataFrame, known: DataFrame, domains: list[str], use: list[int], shares: dict[int, float]) -> tuple[dict[int, float], dict[int, float]]:
    """(slopes, constants) of the curve that fits the labels of the sampled rows that were not counted; one small aggregate a step."""
    held = known.where(settling("doc_id") & F.col("domain").isin([domains[k] for k in use]))
    rows = written(scores.join(F.broadcast(held), "doc_id").drop("doc_id", "n_words"), "settling")
    names = [*(("a", k) for k in use), *(("c", k) for k in use[1:])]  # the first constant stays
    at = {**{("a", k): 0.0 for k in use}, **{("c", k): shares[k] for k in use}}
    factor = lambda name: F.col(f"z{name[1]}") if name[0] == "a" else F.lit(1.0)
    best, move = None, []
    for _ in range(STEPS):
        p = _probabilities(use, {k: at["a", k] for k in use}, {k: at["c", k] for k in use})
        is_ = {k: (F.col("domain") == domains[k]).cast("double") for k in use}
        cells = {"n": F.count("*"), "fit": F.sum(sum((is_[k] * F.log(F.greatest(p[k], F.lit(1e-300))) for k in use), F.lit(0.0)))}
        cells |= {f"g{i}": F.sum(factor(x) * (is_[x[1]] - p[x[1]])) for i, x in enumerate(names)}
        cells |= {f"h{i}_{j}": F.sum(factor(x) * factor(y) * p[x[1]] * ((1.0 if x[1] == y[1] else 0.0) - p[y[1]])) for i, x in enumerate(names) for j, y in enumerate(names[:i + 1])}
        row = rows.agg(*[c.alias(name) for name, c in cells.items()]).first()
        if not row["n"]:
            return {k: 1.0 for k in use}, dict(shares)
        pull = RIDGE * row["n"]
        value = row["fit"] - pull * sum(at[x] ** 2 for x in names) / 2
        if best is not None and value < best[0] - 1e-9:  # too long a step
            move = [x / 2 for x in move]
        else:
            done = best is not None and value < best[0] + 1e-7 * row["n"]
            best = value, dict(at)
            if done:
                break
            size = range(len(names))
            hess = [[row[f"h{max(i, j)}_{min(i, j)}"] + (pull if i == j else 0.0) for j in size] for i in size]
            move = _solved(hess, [row[f"g{i}"] - pull * at[x] for i, x in enumerate(names)])
        at = {**best[1], **{x: best[1][x] + m for x, m in zip(names, move)}}
    return {k: best[1]["a", k] for k in use}, {k: best[1]["c", k] for k in use}


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, p0, p1, ...) per row of ``docs``, stored; ``labelled(doc_id, domain)`` names the domains of some."""
    each = range(len(domains))
    known = written(sampled(labelled, domains, rows), "known")
    weights = word_weights(docs, known, domains)
    shares = weights.select(*[f"prior{k}" for k in each]).first()
    use = [k for k in each if shares[k] is not None]
    scores = weighed(docs, weights, domains)
    if not use:
        return scores.select("doc_id", "n_words", *[F.lit(0.0).alias(f"p{k}") for k in each])
    p = _probabilities(use, *settled(scores, known, domains, use, {k: shares[k] for k in use}))
    return written(scores.select("doc_id", "n_words", *[p.get(k, F.lit(0.0)).alias(f"p{k}") for k in each]), "posteriors")


def solve(placed: DataFrame, targets: list[float], total: float | None = None, most: float | None = None, pull: float = PULL,
          rounds: int = ROUNDS, whole: int | None = None) -> DataFrame:
    """``placed(n_words, p0, ...)`` with the rate of each row; ``whole`` is the number of the domain that is kept whole."""
    each, t = range(len(targets)), F.col("n_words")
    first = placed.agg(F.sum(t).alias("d"), *[F.sum(t * F.col(f"p{k}")).alias(f"s{k}") for k in each]).first()
    words = float(first["d"] or 0)
    share = [float(first[f"s{k}"] or 0.0) / words if words else 0.0 for k in each]
    use = [k for k in each if share[k] > 0]
    asked = sum(targets[k] for k in use)
    at = placed.withColumn("rate", F.lit(1.0))
    if not use or asked <= 0 or (whole is not None and (whole not in use or targets[whole] <= 0)):
        return at
    part = {k: targets[k] / asked for k in use}
    if whole is not None:
        total = share[whole] / part[whole]
    elif total is None:
        total = min(share[k] / part[k] for k in use if part[k] > 0)
    goal = {k: total * part[k] if whole is None else min(share[k], total * part[k]) for k in use}
    step = 1.0 / (1.0 + pull)
    rate, held = F.col("rate"), {k: share[k] for k in use}
    for turn in range(1, rounds + 1):
        push = sum((F.col(f"p{k}") * F.lit(step * (held[k] - goal[k]) / share[k]) for k in use), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate * F.lit(1.0 - step * pull) + F.lit(step * pull) - push)
        rate = rate if most is None else F.least(F.lit(float(most)), rate)
        if turn % CHAINED == 0:  # a longer chain takes Spark longer to plan than to store
            at, rate = written(at.withColumn("rate", rate), "rates"), F.col("rate")
        row = at.withColumn("_rate", rate).agg(*[F.sum(t * F.col(f"p{k}") * F.col("_rate")).alias(f"a{k}") for k in use]).first()
        before, held = held, {k: float(row[f"a{k}"]) / words for k in use}
        if max(abs(held[k] - before[k]) for k in use) < TOLERANCE:
            break
    return at.withColumn("rate", rate)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, most: float | None = None,
        whole: str | None = None) -> DataFrame:
    """(doc_id, n_words, p_<domain> ..., rate) per row of ``docs``; ``labelled(doc_id, domain)`` names the domains of some."""
    domains = sorted(targets)
    placed = posteriors(docs, labelled, domains)
    rated = solve(placed, [targets[d] for d in domains], total, most, whole=None if whole is None else domains.index(whole))
    return rated.select("doc_id", "n_words", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate")


def copies(rate: Column, key: Column) -> Column:
    """Whole copies whose mean is ``rate``: the fraction is decided by a hash of the key."""
    unit = F.pmod(F.xxhash64(F.lit("mix"), key.cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (unit < rate - F.floor(rate)).cast("long")).cast("int")


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, most: float | None = None,
                    whole: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with all their columns."""
    rated = mix(docs, labelled, targets, total, most, whole).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("rate").alias("_rate"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"))
    joined = rows.join(rated, F.col("_key").eqNullSafe(F.col("_id")))
    return joined.where(copies(F.col("_rate"), F.col("_key")) > 0).select(
        F.explode(F.array_repeat("_row", copies(F.col("_rate"), F.col("_key")))).alias("_row")).select("_row.*")
