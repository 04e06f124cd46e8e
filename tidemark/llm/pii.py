"""Personal information inside free text: bootstrapped contextual extraction.

Seed entities induce lexical patterns, and patterns discover further entities:

1. ``surface.candidates`` lists the spans of every text that may be personal information, with the words
   to the left and right of each. Whole texts are read, quotes and signatures included.
2. Seeds are the given names of a list, numbers of a shape that phone or identity numbers have, and
   addresses written with capitals.
3. Spark scores the graph of patterns and instances, round by round. A pattern is as good as the share of
   its instances that are good; an instance is as good as its patterns. For names the instances are pairs of
   given and family name, which also have the name parts that other pairs share, and are bad when they stand
   after determiners or are made of ordinary words. For numbers they are shapes: one that mostly stands
   after words at which other shapes are no numbers of the kind is given up, seed or not. For addresses they
   are streets.
4. Occurrences that reach the threshold are found; overlapping ones are resolved by score, then length.
   ``way`` says what found them: form (emails), seed, pattern, or street (known from elsewhere).

All statistics are counted over all texts. Only the list of given names (at most ``MOST_SEEDS``) and the
ordinary words (at most 1 / ``ORDINARY_SHARE``, by their share) are shipped to the tasks; scores are joined.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import surface
from tidemark.storage import written

#: Part of all words that an ordinary word has at least; so there are at most 1 / ORDINARY_SHARE, 200,000.
ORDINARY_SHARE = 5e-6
#: Given names that are shipped to the tasks at most; a longer list raises an error.
MOST_SEEDS = 1_000_000
#: Rounds of scoring patterns and instances.
ROUNDS = 3
#: A pattern below this share of good instances says nothing.
PATTERN_FLOOR = 0.3
#: Score from which an occurrence is found.
THRESHOLD = 0.5
#: Share of a street's occurrences in capitals from which it is known; of a context's addresses below which none is one.
STREET_SHARE = 0.1

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
_CANDIDATES = "row long, doc_id long, kind string, start_at int, end_at int, form string, first string, second string, left string, right string, flag int"


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """For each word (in lower case) how often it occurs, ``n``, and how often in small letters, ``small``.

    Tags and whatever holds digits or signs of addresses and handles are no words.
    """
    plain = F.regexp_replace(text, "<[^<>]*+>", " ")
    tokens = documents.select(F.explode(F.split(plain, r"\s+")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # what is between blanks is taken apart once for all its occurrences
    tokens = tokens.where(~F.col("t").rlike(r"[@\d_＠]|[\[(](?:at|AT)[\])]"))
    words = tokens.select(F.explode(F.split("t", r"[^\p{L}'-]+")).alias("w"), "n").where(F.length("w") >= 2)
    counts = words.groupBy("w").agg(F.sum("n").alias("n"))
    small = F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0))
    return counts.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), small.alias("small"))


def ordinary_words(counts: DataFrame) -> set[str]:
    """Words of at least five in a million, and five, of all words, 60 % in small letters."""
    least = F.greatest(F.lit(5), F.lit(ORDINARY_SHARE) * counts.agg(F.sum("n")).scalar())
    frequent = counts.where((F.col("n") >= least) & (F.col("small") >= 0.6 * F.col("n")))
    return {r.word for r in frequent.select("word").collect()}


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def candidate_table(documents: DataFrame, ordinary: set[str], seeds: set[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All candidate spans of all texts; a null text has none."""

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r, d, *c) for r, d, t in zip(pdf["row"], pdf["doc_id"], pdf["text"]) for c in surface.candidates(t, ordinary, seeds)]
            yield pd.DataFrame(rows, columns=["row", "doc_id", "kind", "start_at", "end_at", "form", "first", "second", "left", "right", "flag"])

    source = documents.where(F.col(text).isNotNull()).select(_row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInPandas(extract, _CANDIDATES)


def _bit(flag: int) -> Column:
    return F.col("flag").bitwiseAND(flag) > 0


def score_names(names: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scores of pairs (given, family), given names, family names and patterns, from the graph of all candidates."""
    evidence = names.where("first IS NOT NULL AND form IN ('full', 'turned')")
    pairs = evidence.groupBy("first", "second").agg(
        F.avg(_bit(surface.AFTER_DETERMINER).cast("int")).alias("determined"),
        F.avg(_bit(surface.BEFORE_GIVEN).cast("int")).alias("greeting"),
        F.max(F.col("flag").bitwiseAND(surface.ORDINARY_GIVEN | surface.ORDINARY_FAMILY | surface.SEED_GIVEN | surface.SEED_FAMILY)).alias("flag"),
    )
    # a family name seldom stands alone: of its occurrences in capitals a tenth at least are in the form of a name
    word = F.element_at(F.split("second", " "), -1)
    bound = names.where("form <> 'small' AND form <> 'parted'").select(word.alias("word"), "row", "end_at").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("in_names"))
    loose = counts.join(bound, "word").where(F.col("in_names") < 0.1 * (F.col("n") - F.col("small"))).select(F.col("word").alias("loose"))
    pairs = pairs.join(loose, word == F.col("loose"), "left")
    seed = _bit(surface.SEED_GIVEN)
    bad = (F.col("determined") >= 0.2) | (~seed & (F.col("greeting") >= 0.5)) | _bit(surface.ORDINARY_GIVEN) | _bit(surface.ORDINARY_FAMILY) | _bit(surface.SEED_FAMILY) | F.col("loose").isNotNull()
    pairs = pairs.select("first", "second", seed.alias("seed"), bad.alias("bad"))
    # a first word that stands before many given names of the list is no given name
    callers = pairs.where(~F.col("seed")).groupBy("first").agg(F.avg(F.col("bad").cast("int")).alias("share")).where("share >= 0.3").select(F.col("first").alias("caller"))
    pairs = pairs.join(callers, F.col("first") == F.col("caller"), "left").withColumn("bad", F.col("bad") | F.col("caller").isNotNull())
    pairs = written(pairs.select("first", "second", "bad", (F.col("seed") & ~F.col("bad")).cast("double").alias("x")), "pii-pairs")
    # a pattern is known by its words, whether the pair is turned, and the side
    prefix = F.when(F.col("form") == "turned", "t").otherwise("f")
    sides = F.explode(F.array(F.concat(prefix, F.lit("< "), F.col("left")), F.concat(prefix, F.lit("> "), F.col("right")))).alias("pattern")
    edges = written(evidence.select("first", "second", sides).distinct(), "pii-edges")
    for _ in range(rounds):
        scored = edges.join(pairs, ["first", "second"])
        patterns = scored.groupBy("pattern").agg((F.sum("x") / (F.count(F.lit(1)) + F.lit(1.0))).alias("s")).where(F.col("s") >= PATTERN_FLOOR)
        support = edges.join(patterns, "pattern").groupBy("first", "second").agg((1 - F.exp(F.sum(F.log(1 - 0.9 * F.col("s"))))).alias("y"))
        known = pairs.join(support, ["first", "second"], "left").withColumn("y", F.when(F.col("bad"), 0.0).otherwise(F.greatest(F.coalesce("y", F.lit(0.0)), F.col("x"))))
        known = written(known, "pii-known")
        n = F.count(F.lit(1)).alias("n")
        givens = known.groupBy("first").agg((F.sum("y") / (F.count(F.lit(1)) + F.lit(1.0))).alias("a"), n)
        families = known.groupBy("second").agg((F.sum("y") / (F.count(F.lit(1)) + F.lit(1.0))).alias("b"), n)
        both = known.join(givens.withColumnRenamed("n", "na"), "first").join(families.withColumnRenamed("n", "nb"), "second")
        # what the other pairs of the same given name and of the same family name say
        others = {k: (F.col(k) * (F.col(f"n{k}") + 1) - F.col("y")) / F.col(f"n{k}") for k in ("a", "b")}
        x = 1 - (1 - F.col("y")) * (1 - 0.7 * others["a"]) * (1 - 0.7 * others["b"])
        others = F.greatest(others["a"], others["b"]).alias("others")
        pairs = written(both.select("first", "second", "bad", F.when(F.col("bad"), 0.0).otherwise(x).alias("x"), others), "pii-pairs")
    return pairs, givens.drop("n"), families.drop("n"), patterns


def decide_names(names: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The name candidates that reach the threshold, with their ``score``."""
    pairs, givens, families, patterns = score_names(names, counts, rounds)
    prefix = F.when(F.col("form") == "turned", "t").otherwise("f")
    n = names.withColumns({"p": F.concat(prefix, F.lit("< "), F.col("left")), "q": F.concat(prefix, F.lit("> "), F.col("right"))})
    n = n.join(pairs.select("first", "second", "x", "bad", "others"), ["first", "second"], "left")
    n = n.join(givens, "first", "left").join(families, "second", "left")
    n = n.join(patterns.select(F.col("pattern").alias("p"), F.col("s").alias("sl")), "p", "left")
    n = n.join(patterns.select(F.col("pattern").alias("q"), F.col("s").alias("sr")), "q", "left")
    zero = {c: 0.0 for c in ("x", "others", "a", "b", "sl", "sr")}
    n = n.fillna(zero).fillna({"bad": False})
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    # a given name of the list is one wherever it stands
    a = F.when(_bit(surface.SEED_GIVEN), F.greatest(a, F.lit(0.6))).otherwise(a)
    context = 1 - (1 - F.col("sl")) * (1 - F.col("sr"))
    named = ~_bit(surface.ORDINARY_FAMILY) & ~_bit(surface.SEED_FAMILY)
    form, both = F.col("form"), (a >= 0.3) & (b >= 0.3)
    score = (
        F.when(F.col("bad") | ~named, 0.0)
        .when(form.isin("small", "large", "parted"), F.when(both, 0.5 + (a + b) / 4).when(a >= 0.3, context - 0.1).otherwise(0.0))
        .when(F.col("first").isNull(), F.greatest(F.when(b >= 0.3, 0.5 + b / 2).otherwise(0.0), F.when(form == "initials", context - 0.15).otherwise(0.0)))
        .when(form == "turned", F.when(both, 0.6 + b / 3).when((b >= 0.3) | (a >= 0.3), F.greatest(context, x) - 0.2).otherwise(context - 0.4))
        .otherwise(F.when((F.col("others") >= 0.3) | _bit(surface.SEED_GIVEN), F.greatest(x, context)).otherwise(F.greatest(context, x) - 0.45))
    )
    way = F.when(_bit(surface.SEED_GIVEN), "seed").otherwise("pattern")
    return n.withColumns({"score": score, "way": way}).where(F.col("score") >= THRESHOLD)


def decide_numbers(numbers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Phone and identity numbers, by the words before them and by what stands before others of their shape.

    Shapes of a kind are the seeds of its patterns. In the end every shape is as good as the patterns of its
    occurrences, a seed counted as one good occurrence more; an occurrence is of the kind for which its own
    pattern or, for a seed, its shape says most.
    """
    words = F.split("left", " ")
    n = numbers.withColumns({"w3": F.col("left"), "w2": F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " "), "w1": F.element_at(words, -1)})
    edges = written(n.select("form", F.col("first").alias("shape"), F.explode(F.array(F.concat(F.lit("3 "), "w3"), F.concat(F.lit("2 "), "w2"), F.concat(F.lit("1 "), "w1"))).alias("pattern")).groupBy("form", "shape", "pattern").agg(F.count(F.lit(1)).alias("n")), "pii-shapes")
    shapes = edges.select("form", "shape").distinct().withColumns({"phone": (F.col("form") == "phone").cast("double"), "id": (F.col("form") == "id").cast("double")})
    for i in range(rounds):
        scored = edges.join(shapes, ["form", "shape"])
        patterns = scored.groupBy("pattern").agg(*[(F.sum(F.col("n") * F.col(k)) / (F.sum("n") + F.lit(1.0))).alias(k) for k in ("phone", "id")])
        patterns = written(patterns.where(F.greatest("phone", "id") >= PATTERN_FLOOR), "pii-number-patterns")
        if i + 1 < rounds:
            good = edges.join(patterns, "pattern", "left")
            mean = {k: F.when(F.col("form") == k, 1.0).when(F.col("form") == "open", F.sum(F.col("n") * F.coalesce(k, F.lit(0.0))) / F.sum("n")).otherwise(0.0).alias(k) for k in ("phone", "id")}
            shapes = good.groupBy("form", "shape").agg(*mean.values())
    scores = []
    for w in ("3", "2", "1"):
        p = patterns.select(F.col("pattern").alias(f"_p{w}"), F.col("phone").alias(f"_phone{w}"), F.col("id").alias(f"_id{w}"))
        n = n.join(p, F.concat(F.lit(f"{w} "), F.col(f"w{w}")) == F.col(f"_p{w}"), "left")
        scores.append(w)
    best = {k: F.greatest(*[F.coalesce(F.col(f"_{k}{w}"), F.lit(0.0)) for w in scores]) for k in ("phone", "id")}
    n = n.withColumns({"_phone": best["phone"], "_id": best["id"]})
    n = written(n, "pii-numbers")
    seen = n.where("form <> 'open'").groupBy(F.col("form").alias("_f"), F.col("first").alias("_shape"))
    shape = seen.agg(((1 + F.sum(F.when(F.col("form") == "phone", F.col("_phone")).otherwise(F.col("_id")))) / (1 + F.count(F.lit(1)))).alias("_own"))
    n = n.join(shape, (F.col("form") == F.col("_f")) & (F.col("first") == F.col("_shape")), "left")
    own = {k: F.greatest(F.col(f"_{k}"), F.when(F.col("form") == k, F.col("_own")).otherwise(0.0)) for k in ("phone", "id")}
    kind = F.when(own["phone"] >= F.greatest(own["id"], F.lit(PATTERN_FLOOR)), "phone").when(own["id"] >= PATTERN_FLOOR, "id")
    way = F.when(F.col("form") == F.col("kind"), "seed").otherwise("pattern")
    return n.withColumns({"kind": kind, "score": F.lit(2.0)}).where(F.col("kind").isNotNull()).withColumn("way", way)


def decide_addresses(addresses: DataFrame) -> DataFrame:
    """Addresses by how they are written, by their street, and by the words before them.

    One written with capitals is a seed. A street is known when at least ``STREET_SHARE`` of its occurrences
    are seeds. A context is as good as the share of its addresses whose street is known: below
    ``STREET_SHARE`` it makes nothing an address, above a half everything (but French ones, whose end only
    a known street tells).
    """
    streets = addresses.groupBy(F.col("first").alias("_street")).agg(F.avg((F.col("flag") > 0).cast("int")).alias("_share"))
    a = addresses.join(streets.where(F.col("_share") >= STREET_SHARE), F.col("first") == F.col("_street"), "left")
    a = written(a.withColumn("_known", F.col("_street").isNotNull()), "pii-addresses")
    contexts = a.groupBy(F.col("left").alias("_left")).agg(F.sum(F.col("_known").cast("int")).alias("_good"), F.count(F.lit(1)).alias("_n"))
    a = a.join(contexts, F.col("left") == F.col("_left"), "left")
    pattern = F.col("_good") / (F.col("_n") + 1)
    found = F.when((F.col("_good") + 1) / (F.col("_n") + 1) < STREET_SHARE, False).otherwise(F.col("_known") | (F.col("form") != "fr") & (pattern >= 0.5))
    way = F.when(F.col("flag") > 0, "seed").when(F.col("_known"), "street").otherwise("pattern")
    return a.where(found).withColumns({"score": F.when(F.col("_known"), 3.0).otherwise(2.5), "way": way})


def _resolve(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of a text keep the one of greatest score, then the longest, then the first."""

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row, doc, found in zip(pdf["row"], pdf["doc_id"], pdf["found"]):
                taken: list = []  # (start, end, kind, way), in order, none overlapping
                for s in sorted(found, key=lambda s: (-s["score"], s["start_at"] - s["end_at"], s["start_at"], s["kind"])):
                    i = bisect_left(taken, (s["start_at"],))
                    if (not i or taken[i - 1][1] <= s["start_at"]) and (i == len(taken) or s["end_at"] <= taken[i][0]):
                        taken.insert(i, (s["start_at"], s["end_at"], s["kind"], s["way"]))
                out += [(row, doc, kind, a, b, way) for a, b, kind, way in taken]
            yield pd.DataFrame(out, columns=["row", "doc_id", "kind", "start_at", "end_at", "way"])

    per_text = spans.groupBy("row", "doc_id").agg(F.collect_set(F.struct("kind", "start_at", "end_at", "score", "way")).alias("found"))
    return per_text.mapInPandas(keep, "row long, doc_id long, kind string, start_at int, end_at int, way string")


def find_personal_information(documents: DataFrame, given_names: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: row (key of the text), doc_id, kind, start_at, end_at, in code points, and way.

    Nulls: a null or empty text has no pieces, a null document number is kept. Repeated rows give their
    pieces once. Very long texts are read whole. Without given names, shapes alone are the seeds. Other
    columns are not touched.
    """
    seeds = {r[0].lower() for r in given_names.select("given_name").where("given_name IS NOT NULL").distinct().collect()}
    if len(seeds) > MOST_SEEDS:
        raise ValueError(f"{len(seeds)} given names are more than {MOST_SEEDS}")
    counts = written(word_counts(documents, text), "pii-words")
    ordinary = ordinary_words(counts) - seeds
    c = written(candidate_table(documents, ordinary, seeds, doc_id, text), "pii-candidates")
    columns = ["row", "doc_id", "kind", "start_at", "end_at", "score", "way"]
    found = c.where("kind = 'email'").withColumns({"score": F.lit(4.0), "way": F.lit("form")}).select(columns)
    found = found.unionByName(decide_addresses(c.where("kind = 'address'")).select(columns))
    found = found.unionByName(decide_numbers(c.where("kind = 'number'")).select(columns))
    found = found.unionByName(decide_names(c.where("kind = 'name'"), counts).select(columns))
    return _resolve(found)


def held_out(documents: DataFrame, given_names: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What patterns find of names whose given name is not on the list: one row with counts.

    Half of the given names, by hash, are withheld; of the names that the whole list finds and whose given name
    is withheld, ``n_found_again`` are found all the same.
    """
    g = given_names.select("given_name").where("given_name IS NOT NULL").distinct()
    keep = F.pmod(F.xxhash64(F.lower("given_name")), F.lit(2)) == 0
    at = ["row", "doc_id", "start_at", "end_at"]
    all_found = written(find_personal_information(documents, g, doc_id=doc_id, text=text).where("kind = 'name'"), "pii-all")
    half = find_personal_information(documents, g.where(keep), doc_id=doc_id, text=text).where("kind = 'name'").select(*[F.col(c).alias(f"_{c}") for c in at])
    texts = documents.select(_row_key(doc_id, text).alias("_r"), F.col(text).alias("_text")).dropDuplicates(["_r"])
    piece = F.lower(F.substring(F.col("_text"), F.col("start_at") + 1, F.col("end_at") - F.col("start_at")))
    names = all_found.where("way = 'seed'").join(texts, F.col("row") == F.col("_r")).withColumn("piece", piece)
    # a name holds one given name of the list as a word
    parts = names.select(*at, F.explode(F.split("piece", r"[^\p{L}]+")).alias("w"))
    withheld = g.where(~keep).select(F.lower("given_name").alias("_g"))
    lost = parts.join(withheld, F.col("w") == F.col("_g"), "left_semi").select(*at).distinct()
    both = lost.join(half, F.expr(" AND ".join(f"{c} <=> _{c}" for c in at)), "left")
    return both.agg(F.count(F.lit(1)).alias("n_withheld"), F.count("_start_at").alias("n_found_again"))


def redact(documents: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with each piece replaced by its placeholder; everything else is unchanged."""
    pieces = found.groupBy(F.col("row").alias("r"), F.col("doc_id").alias("rd")).agg(F.sort_array(F.collect_set(F.struct("start_at", "end_at", "kind"))).alias("p"))
    whole = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("d"), _row_key(doc_id, text).alias("k"), F.col(doc_id).cast("long").alias("kd"))  # names may clash with ours
    joined = whole.join(pieces, (F.col("k") == F.col("r")) & F.col("kd").eqNullSafe(F.col("rd")), "left")

    @F.pandas_udf(T.StringType())
    def fill(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, found):
            if t is not None and spans is not None:
                parts, end = [], 0
                for s in spans:
                    parts += [t[end : s["start_at"]], PLACEHOLDERS[s["kind"]]]
                    end = s["end_at"]
                t = "".join(parts) + t[end:]
            out.append(t)
        return pd.Series(out, dtype=object)

    columns = [fill(F.col("d")[text], F.col("p")).alias(c) if c == text else F.col("d")[c].alias(c) for c in documents.columns]
    return joined.select(*columns)
