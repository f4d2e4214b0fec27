"""License scan by ordered signature rules, in DataFrame functions only.

A rule has a priority, a label, keywords and a regex over the normalised text (words joined by single
spaces). A text is tried only against rules whose keywords it holds. Detections are intervals of the
normalised text, and overlapping ones are resolved in this order: one that overlaps, contains or lies within one of
better priority goes; among equal priorities one that lies within another or overlaps one that starts before it goes
(at one start the longer one stays, then the label first in order). What is left gives the labels and the score.
Base phrases are rules that are never suppressed.

Rules are hand-written signatures of licence texts, tags, notices and addresses (``signatures``), and hand-written
names of licences in the forms in which texts name them (``NAMES``, ``FORMS``).

Defined cases: null and wordless texts have no detections, no labels and score 0; repeated rows get equal results. Other columns
are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, signatures

#: phrase: label. Places where these words stand one after the other are always reported.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: (starts of the name, one of which must occur; regex of the name in normalised text). Fixed values, written by hand.
NAMES: dict[str, tuple[str, str]] = {
    "mit": ("mit|the mit", "(?:the )?mit(?: expat)?"), "apache-1.1": ("apache", "apache(?: software)?(?: license)?(?: version)? 1 1"), "apache-2": ("apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    "bsd-2-clause": ("simplified bsd|freebsd|bsd|2 clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)"), "bsd-3-clause": ("bsd|new bsd|3 clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"), "bsd-4-clause": ("bsd|original bsd|4 clause", "(?:original bsd|bsd 4 clause|4 clause bsd)"), "0bsd": ("0bsd|zero clause|bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    "gpl-1": ("gpl|gnu general", "(?:gpl|gnu general public license)(?: version| v)? ?(?:v)?1(?: 0)?"), "gpl-2": ("gpl|gnu general", "(?:gpl|gnu general public license)(?: version| v)? ?(?:v)?2(?: 0)?"), "gpl-3": ("gpl|gnu general", "(?:gpl|gnu general public license)(?: version| v)? ?(?:v)?3(?: 0)?"),
    "lgpl-2": ("lgpl|gnu library", "(?:lgpl|gnu library general public license)(?: version| v)? ?(?:v)?2(?: 0)?"), "lgpl-2.1": ("lgpl|gnu lesser", "(?:lgpl|gnu lesser general public license)(?: version| v)? ?(?:v)?2 1"), "lgpl-3": ("lgpl|gnu lesser", "(?:lgpl|gnu lesser general public license)(?: version| v)? ?(?:v)?3(?: 0)?"),
    "agpl-3": ("agpl|gnu affero", "(?:agpl|gnu affero general public license)(?: version| v)? ?(?:v)?3(?: 0)?"), "mpl-1.1": ("mpl|mozilla", "(?:mpl|mozilla public license)(?: version| v)? ?1 1"), "mpl-2": ("mpl|mozilla", "(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?"),
    "epl-1": ("epl|eclipse", "(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?"), "epl-2": ("epl|eclipse", "(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?"), "cddl-1": ("cddl|common development", "(?:cddl|common development and distribution license)(?: version)? ?1(?: 0)?"), "isc": ("isc", "isc"),
    "zlib": ("zlib", "zlib(?: libpng)?"), "bsl-1": ("boost", "boost(?: software)?(?: license)?(?: version)?(?: 1 0)?"), "unlicense": ("unlicense|the unlicense", "(?:the )?unlicense"), "wtfpl": ("wtfpl", "wtfpl"), "artistic-1": ("artistic", "artistic(?: license)?(?: version)? 1 0"), "artistic-2": ("artistic", "artistic(?: license)?(?: version)? 2 0"),
    "eupl-1.2": ("eupl|european union", "(?:eupl|european union public licen[cs]e)(?: version| v)?(?: 1 2)?"), "cecill": ("cecill", "cecill"), "ofl-1.1": ("ofl|sil open", "(?:ofl|sil open font license)(?: version)?(?: 1 1)?"), "psf-2": ("psf|python software", "(?:psf|python software foundation license)(?: version)?(?: 2)?"), "php-3": ("php", "php(?: license)? 3 01?"), "ruby": ("ruby", "ruby"),
    "w3c": ("w3c", "w3c(?: software)?(?: notice)?"), "x11": ("x11", "x11"), "openssl": ("openssl", "openssl"), "postgresql": ("postgresql", "postgresql"), "ncsa": ("ncsa|university of illinois", "(?:ncsa|university of illinois ncsa)"), "afl-3": ("afl|academic free", "(?:afl|academic free license)(?: version)?(?: 3 0)?"), "osl-3": ("osl|open software", "(?:osl|open software license)(?: version)?(?: 3 0)?"),
    "odbl": ("odbl|open database", "(?:odbl|open database license)(?: 1 0)?"), "odc-by": ("odc|open data", "(?:odc by|open data commons attribution license)(?: 1 0)?"), "pddl": ("pddl|public domain dedication", "(?:pddl|public domain dedication and license)"), "cc0": ("cc0|cc zero|creative commons", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?"), "cc-by": ("cc by|creative commons", "(?:cc by|creative commons attribution)(?: [1234] [05])?"),
    "cc-by-sa": ("cc by|creative commons", "(?:cc by sa|creative commons attribution sharealike|creative commons attribution share alike)(?: [1234] [05])?"), "cc-by-nc": ("cc by|creative commons", "(?:cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial)(?: [1234] [05])?"), "cc-by-nd": ("cc by|creative commons", "(?:cc by nd|creative commons attribution noderivatives|creative commons attribution no derivatives)(?: [1234] [05])?"),
    "cc-by-nc-sa": ("cc by|creative commons", "(?:cc by nc sa|creative commons attribution noncommercial sharealike|creative commons attribution non commercial share alike)(?: [1234] [05])?"), "cc-by-nc-nd": ("cc by|creative commons", "(?:cc by nc nd|creative commons attribution noncommercial noderivatives|creative commons attribution non commercial no derivatives)(?: [1234] [05])?"),
    "gfdl": ("gfdl|gnu free", "(?:gfdl|gnu free documentation license)(?: version)?(?: 1 [123])?"), "vim": ("vim", "vim"), "json": ("json", "json"), "tcl": ("tcl", "tcl"), "upl-1": ("upl|universal permissive", "(?:upl|universal permissive license)(?: version)?(?: 1 0)?"), "ms-pl": ("ms pl|microsoft public", "(?:ms pl|microsoft public license)"),
}
#: (name, priority, share of certainty, keyword, regex with NAME in it). The forms in which a licence is named; fixed values.
FORMS: list[tuple[str, int, float, str, str]] = [
    ("tag", 1, 1.0, "spdx", "spdx license identifier NAME"), ("grant", 2, 0.95, "licensed", "(?:is |are )?licensed under (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?"), ("release", 3, 0.9, "under", "(?:released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?"),
    ("named", 4, 0.8, "licen", "NAME licen[cs]e"), ("field", 5, 0.7, "licen", "licen[cs]e (?:is )?(?:the )?NAME"),
]
def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules in order: label, priority, certainty, keywords, regex. Keywords are word starts: ``&`` joins groups that must all occur, ``|`` alternatives in a group."""
    made = [(label, pr, c, f"{kw}&{own}", form.replace("NAME", name)) for label, (own, name) in NAMES.items() for _, pr, c, kw, form in FORMS]
    return sorted([*made, *signatures.table()], key=lambda r: (r[1], r[0], r[4]))


def gate(lowered: Column, keywords: set[str]) -> Column:
    """Whether all words of any of the keyword groups occur."""
    groups = sorted(keywords)
    # a group that holds another group's words adds nothing
    least = [g for g in groups if not any(h != g and set(h.split()) < set(g.split()) for h in groups)]
    out = F.lit(False)
    for g in least:
        each = F.lit(True)
        for w in g.split():
            each = each & F.contains(lowered, F.lit(w))
        out = out | each
    return F.coalesce(out, F.lit(False))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, base: dict[str, str] | None = None, table: list[tuple[str, int, float, str, str]] | None = None) -> DataFrame:
    """A row for each document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base, rules_ = BASE if base is None else base, rules()
    table = rules_ if table is None else table
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    # the texts' own gate: the forms' keywords and the phrases' words; licence names are looked for behind it
    gates = {f[3] for f in FORMS} | {r[3] for r in signatures.table()} | set(base) if table is rules_ else {w for r in table for w in r[3].split("&")[0].split("|")} | set(base)
    # a generator keeps the lower-cased text from being made again for each keyword of the gate
    rows = rows.select("d", "h", common.word_count(F.col("t")).alias("n_words"), "t", F.explode(F.array(F.lower("t"))).alias("lt"))
    rows = rows.select("d", "h", "n_words", F.when(gate(F.col("lt"), gates), F.col("t")).alias("t"))
    rows = rows.select("d", "h", "n_words", F.when(F.col("t").isNotNull(), F.concat(F.lit(" "), F.array_join(common.words_of(F.col("t")), " "), F.lit(" "))).alias("norm"))

    # 1. base phrases, by their first word with the others ahead
    parts = rows
    for i, p in enumerate(base):
        first, _, rest = p.partition(" ")
        parts = parts.withColumn(f"p{i}", F.when(F.col("norm").contains(f" {p} "), F.split(F.col("norm"), f"(?<= ){first}(?= {rest} )" if rest else f"(?<= ){first}(?= )")))
    cols = [F.col(f"p{i}") for i in range(len(base))]
    n_base = sum((F.when(c.isNull(), 0).otherwise(F.size(c) - 1) for c in cols), F.lit(0)).cast("long")
    first = F.least(*[_spaces(c[0]) - 1 for c in cols], F.lit(None).cast("int"))
    last = F.greatest(*[F.col("n_words") - _spaces(F.element_at(c, -1)) for c in cols], F.lit(None).cast("long"))
    labelled = F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(label)) for c, label in zip(cols, base.values())]))
    head = parts.select("d", "h", "n_words", n_base.alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.sort_array(F.array_distinct(labelled)).alias("bl"))

    # 2. rules of which the text holds the keyword, each with its intervals
    groups = [[g.split("|") for g in kw.split("&")] for _, _, _, kw, _ in table]
    every = sorted({w for gs in groups for g in gs for w in g})
    # the table is one literal, folded once: as an expression of its own for each rule it takes the optimizer half a minute
    listed = [{"i": i, "pr": p, "label": label, "c": c, "kw": gs, "rx": f" (?:{rx})(?= )"} for i, ((label, p, c, _, rx), gs) in enumerate(zip(table, groups))]
    literal = F.from_json(F.lit(json.dumps(listed)), "array<struct<i:int,pr:int,label:string,c:double,kw:array<array<string>>,rx:string>>")
    words = F.from_json(F.lit(json.dumps(every)), "array<string>")
    # the generator is a barrier: else the optimizer moves the making of ``norm`` into the lambdas below, once for each keyword
    tried = rows.where(F.col("norm").isNotNull()).select("d", "h", F.explode(F.array("norm")).alias("norm"))
    there = F.filter(words, lambda w: F.contains(F.col("norm"), F.concat(F.lit(" "), w)))
    tried = tried.select("d", "h", "norm", F.explode(F.array(there)).alias("there"))
    tried = tried.select("d", "h", "norm", F.explode(F.filter(literal, lambda r: F.forall(r["kw"], lambda g: F.arrays_overlap(g, F.col("there"))))).alias("r"))
    found = tried.select("d", "h", "r.i", "r.pr", "r.label", "r.c", F.expr("split(norm, r.rx)").alias("gaps"), F.expr("regexp_extract_all(norm, r.rx, 0)").alias("got")).where(F.size("got") > 0)
    each = found.select("d", "h", "i", "pr", "label", "c", F.posexplode(F.arrays_zip("gaps", "got")).alias("k", "x")).where(F.col("x.got").isNotNull())
    each = each.select("d", "h", "i", "pr", "label", "c", "k", F.length("x.gaps").alias("gap"), F.length("x.got").alias("len"))
    # repeated rows detect the same; a detection starts after all gaps and detections before it
    each = each.repartition("d", "h").dropDuplicates(["d", "h", "i", "k"])
    upto = W.partitionBy("d", "h", "i").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    spans = each.select("d", "h", "pr", "label", "c", end.alias("e"), (end - F.col("len")).alias("s"))

    # 3. suppression, by running maxima over starts and ends in order. A detection's start shows how far those of its own
    # priority reach that begin before it; its end shows how far better ones reach that begin before that end.
    levels = sorted({r[1] for r in table})
    points = spans.select("d", "h", "pr", "label", "c", "s", "e", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("e").alias("at"), F.lit(0).alias("opens")))).alias("x"))
    points = points.select("d", "h", "pr", "label", "c", "s", "e", "x.at", "x.opens")
    before = W.partitionBy("d", "h").orderBy("at", "opens", "pr", F.col("e").desc(), "label").rowsBetween(W.unboundedPreceding, -1)
    opened = lambda which: F.max(F.when((F.col("opens") == 1) & which, F.col("e"))).over(before)
    seen = points.select("*", *[opened(F.col("pr") == q).alias(f"own{q}") for q in levels], *[opened(F.col("pr") < q).alias(f"better{q}") for q in levels])
    pick = lambda stem: F.coalesce(*[F.when(F.col("pr") == q, F.col(f"{stem}{q}")) for q in levels], F.lit(-1))
    judged = seen.groupBy("d", "h", "pr", "label", "s", "e").agg(F.max("c").alias("c"), F.min(F.when(F.col("opens") == 1, pick("own"))).alias("own"), F.max(F.when(F.col("opens") == 0, pick("better"))).alias("better"))
    left = judged.where((F.col("own") <= F.col("s")) & (F.col("better") <= F.col("s")))
    more = left.groupBy("d", "h").agg(F.collect_set("label").alias("ml"), F.max("c").alias("mc"))
    out = head.join(more.select(F.col("d").alias("md"), F.col("h").alias("mh"), "ml", "mc"), F.col("d").eqNullSafe(F.col("md")) & (F.col("h") == F.col("mh")), "left")
    labels = F.array_sort(F.array_union("bl", F.coalesce("ml", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("mc", F.lit(0.0)))
    return out.select(F.col("d").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("bl", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
