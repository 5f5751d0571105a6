"""Licence scans with a positional rare-token index; DataFrame functions only, no shuffle.

The index holds, for every licence template, the places of its INDEXED rarest words (highest inverse
document frequency among the templates). Of each template's index words that a file has, the LOOKED_UP
rarest are looked up: each of their occurrences proposes a template and the place where it would start.
Postings are intersected by relative position: a proposal stands if two of these words are in place,
nine tenths of the template's words are, and the template's mandatory key phrase stands in the text.
Base phrases are searched word by word besides. The index is a constant of the plan: its size is that of
the templates, which are whole licences and notices. Only texts that have a word of the index or of a base
phrase are cut into words.

Defined cases: null and empty texts have no words, no places, empty labels and score 0; every
occurrence counts, in texts of any length, and all templates that stand are given, so there are no
ties; repeated rows are scanned each and null ids are kept; an empty table gives no rows; other columns
are not used, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
INDEXED, LOOKED_UP = 8, 4  # words of each template in the index; of those that a file has, the rarest ones looked up
IN_PLACE = 0.9  # share of a template's words that must stand in place
SHIFT = 1024  # more than there are templates
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rare_words(templates=TEMPLATES) -> list[list[str]]:
    """For each template its INDEXED words of highest inverse document frequency, rarest first (longer words first among equals)."""
    sets = [set(t.split()) for _, t, _ in templates]
    df = Counter(w for s in sets for w in s)
    return [sorted(s, key=lambda w: (df[w], -len(w), w))[:INDEXED] for s in sets]


def any_of(words: list[str]) -> str:
    """An expression for any of some words, with common beginnings written once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = ["" if not c else re.escape(c) + any_of(rest) for c, rest in heads.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(sorted(parts, reverse=True)) + ")"


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and the proposals that stand (template, start, share)."""
    if len(templates) > SHIFT:
        raise ValueError(f"more than {SHIFT} templates")
    words, rare = [t.split() for _, t, _ in templates], rare_words(templates)
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (own, best) in enumerate(zip(words, rare, strict=True)):
        for q, w in enumerate(own):
            if w in best:
                index.setdefault(w, []).append((t, q))
    asked = sorted(set(index) | {p.split()[0] for p, _ in base})

    df = docs.select(F.col(key).alias("_key"), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")).alias("_norm"))
    n = F.when(F.col("_norm") == "", 0).otherwise(F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) + 1)
    some = F.col("_norm").rlike("(?i)(?:^| )" + any_of(asked) + "(?: |$)")
    df = df.withColumns({"_n": n.cast("bigint"), "_low": F.when(some, F.translate("_norm", UPPER, LOWER)).otherwise("")}).drop("_norm")
    df = df.withColumn("_w", F.when(F.col("_low") == "", F.array().cast("array<string>")).otherwise(F.split("_low", " ", -1)))

    # base phrases: places by the first word, then word by word
    word = lambda i: F.get(F.col("_w"), i)
    heads = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*{p.split()[0] for p, _ in base}), i)), lambda i: i.isNotNull())
    df = df.withColumn("_heads", heads)
    stands = lambda p: lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(p) - 1)), lambda k: F.coalesce(word(i + k) == F.get(_strings(p), k), F.lit(False)))
    df = df.withColumns({f"_b{k}": F.filter("_heads", stands(p.split())) for k, (p, _) in enumerate(base)})
    df = df.withColumn("_base", F.concat(*(F.col(f"_b{k}") for k in range(len(base)))))
    found = [F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base)]
    df = df.withColumn("_labels", F.array_compact(F.array(*found)))

    # proposals (template, start) of all occurrences of rare words
    posting = F.create_map(*(x for w, at in sorted(index.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in at)))))
    rare_hits = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*index))
    df = df.withColumn("_hits", rare_hits)
    # of each template the rarest words that the text has
    present = F.array_distinct(F.transform("_hits", lambda h: h["w"]))
    orders = F.array(*(F.split(F.lit(" ".join(r)), " ") for r in rare))
    chosen = F.transform(orders, lambda o: F.slice(F.array_intersect(o, present), F.lit(1), F.lit(LOOKED_UP)))
    df = df.withColumn("_chosen", F.when(F.size("_hits") > 0, chosen))
    looked_up = lambda t, w: F.array_contains(F.get(F.col("_chosen"), t), w)
    # a proposal is one number, place * SHIFT + template: numbers are told apart by hashing, structs would be compared in pairs
    of_hit = lambda h: F.transform(F.filter(F.try_element_at(posting, h["w"]), lambda p: looked_up(p["t"], h["w"])), lambda p: (h["i"] - p["q"]).cast("bigint") * SHIFT + p["t"])
    df = df.withColumn("_offers", F.array_distinct(F.flatten(F.transform("_hits", of_hit))))
    df = df.withColumn("_offers", F.transform("_offers", lambda c: F.struct(F.pmod(c, F.lit(SHIFT)).cast("int").alias("t"), F.floor(c / SHIFT).cast("int").alias("o"))))
    sizes = F.array(*(F.lit(len(w)) for w in words))
    all_words = F.array(*(F.split(F.lit(" ".join(w)), " ") for w in words))
    all_rare = F.array(*(F.array(*(F.lit(q) for q, w in enumerate(own) if w in best)) for own, best in zip(words, rare, strict=True)))
    stands_at = lambda c, q: F.when(c["o"] + q >= 0, word(c["o"] + q)) == F.get(F.get(all_words, c["t"]), q)
    in_place = lambda c, places: F.size(F.filter(places, lambda q: stands_at(c, q)))
    own_rare = lambda c: F.filter(F.get(all_rare, c["t"]), lambda q: looked_up(c["t"], F.get(F.get(all_words, c["t"]), q)))
    df = df.withColumn("_offers", F.filter("_offers", lambda c: in_place(c, own_rare(c)) >= 2))
    share = lambda c: in_place(c, F.sequence(F.lit(0), F.get(sizes, c["t"]) - 1)) / F.get(sizes, c["t"])
    keyed = lambda c: F.contains(F.concat(F.lit(" "), F.col("_low"), F.lit(" ")), F.concat(F.lit(" "), F.get(_strings([k for _, _, k in templates]), c["t"]), F.lit(" ")))
    df = df.withColumn("_offers", F.transform("_offers", lambda c: F.struct(c["t"].alias("template"), c["o"].cast("bigint").alias("start"), share(c).alias("share"), keyed(c).alias("keyed"))))
    df = df.withColumn("found", F.transform(F.filter("_offers", lambda c: (c["share"] >= IN_PLACE) & c["keyed"]), lambda c: F.struct(c["template"], c["start"], c["share"])))
    own = F.transform("found", lambda c: F.get(_strings([label for label, _, _ in templates]), c["template"]))
    return df.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_words"),
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min("_base").cast("bigint").alias("first_word"),
        F.array_max("_base").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_labels", own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0)).alias("score"),
        "found",
    )
