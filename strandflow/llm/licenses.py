"""License scans with DataFrame functions only: a positional rare-token index.

Rows are scanned one by one without a shuffle.  The words of whole licence texts, headers and short notices
(``license_texts``) with their places are postings, each word weighted by its inverse document frequency over these templates.
A text's words that are among the templates' rarest are looked up; a hit at place i for
template place j votes for the alignment (template, i - j), and an alignment's score is the matched share of the
template's weight.  A template is reported when its score reaches ``LEAST`` and one of its
mandatory key phrases stands in the text word by word.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

#: Phrases whose places are the base result, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Share of a template's weight that must align.
LEAST = 0.6
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: str) -> str:
    """The words of a text with single spaces between them."""
    return " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)))


#: (label, words of the text, key phrases).
TEMPLATES = tuple((label, plain(text), keys) for label, text, keys in TEXTS)


def _index() -> tuple[list[list[tuple[str, float]]], dict[str, list[tuple[int, int]]]]:
    """Each template's words with their shares of its weight, and the postings (template, place) of the words to look up.

    A template's rarest words are looked up, as many as weigh more than ``1 - LEAST``: no alignment
    reaches ``LEAST`` without one of them.
    """
    split = [t.split(" ") for _, t, _ in TEMPLATES]
    df = Counter(w for ws in split for w in set(ws))
    idf = {w: math.log((1 + len(split)) / n) for w, n in df.items()}
    shares, postings = [], {}
    for n, ws in enumerate(split):
        whole = sum(idf[w] for w in ws)
        shares.append([(w, idf[w] / whole) for w in ws])
        held = 0.0
        for w in sorted(set(ws), key=lambda w: (-idf[w], w)):
            if held > 1 - LEAST + 1e-9:
                break
            held += ws.count(w) * idf[w] / whole
            postings.setdefault(w, []).extend((n, i) for i, x in enumerate(ws) if x == w)
    return shares, postings


def _spaced(text: Column) -> Column:
    """Words joined by single spaces, with a space before and after: `` a b ``."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), _NOT_WORD, " ")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are maximal runs of bytes outside the ASCII non-alphanumerics, A-Z lower-cased.  ``n_base`` counts all places of
    the base phrases, ``first_word``/``last_word`` are their least and greatest start (null if there is none); ``labels``
    adds the templates that align and hold a key phrase; ``score`` is the best share of a template's weight
    among the alignments that a looked-up word votes for (all that reach ``LEAST`` are; 0 if there is none), and 1 where a base phrase stands.  Null texts count as empty; empty texts have no words.  One row for each
    row; rows of equal id and text give equal rows.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    shares, found = _index()
    # Constants, folded when the query is planned: the rare words' postings, and each template's words with their weights.
    # An alignment is one number, its offset before the template's bits: numbers are told apart by hashing, structs pair by pair.
    bits = len(TEMPLATES).bit_length()
    postings = F.from_json(F.lit(json.dumps({w: [n - (i << bits) for n, i in where] for w, where in found.items()})), "map<string,array<bigint>>")
    templates = F.from_json(F.lit(json.dumps([[{"word": w, "weight": x} for w, x in ws] for ws in shares])), "array<array<struct<word:string,weight:double>>>")
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])

    def places(s: Column, words: Column, phrase: str) -> Column:
        want = phrase.split()
        test = lambda w, i: F.slice(words, i + 1, len(want)) == F.array(*map(F.lit, want))
        at = F.filter(F.transform(words, lambda w, i: F.when((w == want[0]) & test(w, i), i)), lambda i: i.isNotNull())
        return F.when(F.contains(s, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<int>"))

    def aligned(words: Column, hits: Column) -> Column:
        """(template, score) of each alignment that a rare word votes for."""
        place = lambda i: F.transform(F.element_at(postings, F.get(words, i)), lambda p: F.shiftleft(i.cast("long"), bits) + p)
        template = lambda c: c.bitwiseAND((1 << bits) - 1).cast("int")
        offset = lambda c: F.shiftright(c, bits).cast("int")
        weights = lambda c: F.transform(F.element_at(templates, template(c) + 1), lambda p, j: F.when(F.get(words, offset(c) + j) == p["word"], p["weight"]).otherwise(0.0))
        score = lambda c: F.least(F.round(F.aggregate(weights(c), F.lit(0.0), lambda x, y: x + y), 9), F.lit(1.0))
        return F.transform(F.array_distinct(F.flatten(F.transform(hits, place))), lambda c: F.struct(template(c).alias("template"), score(c).alias("score")))

    def details(s: Column, words: Column, hits: Column) -> Column:
        keyed = F.array_compact(F.array(*[F.when(_any([F.contains(s, F.lit(f" {k} ")) for k in keys]), F.lit(n)) for n, (_, _, keys) in enumerate(TEMPLATES)]))

        def judged(votes: Column, keyed: Column) -> Column:
            good = F.filter(votes, lambda v: (v["score"] >= LEAST) & F.array_contains(keyed, v["template"]))
            return F.struct(F.array_max(F.transform(votes, lambda v: v["score"])).alias("best"), F.transform(good, lambda v: F.element_at(names, v["template"] + 1)).alias("more"))

        lookup = _let(aligned(words, hits), lambda votes: _let(keyed, lambda k: judged(votes, k)))
        return F.struct(F.array(*[places(s, words, phrase) for phrase, _ in BASE]).alias("places"), lookup.alias("lookup"))

    def scan(s: Column) -> Column:
        n_words = F.when(F.trim(s) == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1)
        based = _any([F.contains(s, F.lit(f" {phrase} ")) for phrase, _ in BASE])
        # Texts without a base phrase and without any of the words to look up need no more than a word count.
        rare = lambda words: F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(found)), i)), lambda i: i.isNotNull())
        some = _let(F.split(F.trim(s), " "), lambda words: _let(rare(words), lambda hits: F.when(based | (F.size(hits) > 0), details(s, words, hits))))
        return F.struct(n_words.cast("long").alias("n_words"), some.alias("some"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _let(_spaced(text), scan).alias("r"))
    none = F.array().cast("array<int>")
    rows = rows.select("doc_id", "r.n_words", F.coalesce("r.some.places", F.array(*[none] * len(BASE))).alias("places"), F.coalesce("r.some.lookup.more", F.array().cast("array<string>")).alias("more"), F.coalesce("r.some.lookup.best", F.lit(0.0)).alias("best"))
    starts = F.flatten("places")
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(n))) > 0, F.lit(label)) for n, (_, label) in enumerate(BASE)]))))
    return rows.select(
        "doc_id", "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "more")), ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.col("best")).alias("score"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
