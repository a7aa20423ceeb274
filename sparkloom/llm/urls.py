"""URL filter: host words by unigram Viterbi, then multinomial naive Bayes over host and path tokens.

Explicit rules decide first.  Every other url is judged by its tokens: the words of its host's labels
and the letter runs of its path.

*Words.*  A host label is often several words run together.  The unigram model counts words that stand
alone: those of all pages' texts (names of hosts in them left out), of paths, and the parts of host
components that something separates; a small lexicon joins them.  A label is no evidence of itself.

*Evidence.*  Whether a page is unwanted is read from its text, not from its url: from terms of abuse and
from words repeated over and over (or from a column that the caller names).  Naive Bayes is fitted on
this evidence outside a held-out fifth of the pages.  Seed words start with odds of their own, which
the evidence may outweigh, and other words gain odds by the company of unwanted pages.

Counts, words and odds are tables, all of them kept, and are joined; nothing that grows goes through
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words that hosts of unwanted sites have, with odds of their own; an argument of :func:`judge`.
SEEDS = tuple(
    "adult ads adserver affiliate banner bet bets betting bonus buy casino cheap click clicks coupon crack dating deal deals drugs escort free gamble gambling hack "
    "jackpot keygen loan loans lottery malware nude payday pharma phish pills poker porn promo pron replica sex sexy slots spam torrent track tracker tracking viagra warez win xxx".split()
)
#: Common words of hosts that texts of pages may lack; they only help to cut labels.
LEXICON = tuple(
    "about archive art author blog book books city club com data design doc docs edu event events example forum gov guide health help history home info job jobs journal "
    "lab learn library live mail map maps media mobile music net news online org page paper photo post press project research school science search shop site sport store "
    "study support team tech the time today travel user video web wiki work world www".split()
)
#: Terms of abuse in a page's text.
ABUSE = tuple("clown disgusting idiot loser moron pathetic scum stupid trash worthless".split())
#: A page is unwanted if this share of its words is abuse, or its words are this often repeats.
ABUSE_SHARE, REPEATS = 0.01, 0.8
#: Log odds that a seed word starts with.
SEED_ODDS = 6.0
#: Letters of a label, and so of a word in it, at most: what the domain name system allows.  A longer run of
#: letters is no label; it is taken as one word.
LABEL = 63
#: Sums of log odds are kept in whole billionths, so that their order does not matter.
UNIT = 10**9
_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """``host`` and ``path`` of ``url``; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _A_Z, _A_Z.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: tuple[Rule, ...]):
    """(rule, verdict) columns: the longest rule that fits ``host`` and ``path``; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, does).otherwise(verdict)
    return rule, verdict


def _runs(text: Column, shortest: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"([\p{{L}}]{{{shortest},}})"), F.lit(1))


def page_words(html: Column) -> Column:
    """Words of a page's text in small letters: without tags, scripts, styles, and names of hosts."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"<[^>]*>|&#?\w+;", " ")
    return _runs(F.lower(F.regexp_replace(text, r"[\w-]+(?:\.[\w-]+)+", " ")))


def content_evidence(words: Column) -> Column:
    """Whether a page with these words is unwanted; null for a page without words."""
    n = F.size(words)
    abuse = F.size(F.filter(words, lambda w: w.isin(*ABUSE)))
    repeats = 1 - F.size(F.array_distinct(words)) / n
    return F.when(n > 0, (abuse >= ABUSE_SHARE * n) | ((repeats >= REPEATS) & (n >= 20)))


def standing_words(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``word, n`` of all words that stand alone on ``pages`` (host, path, words), and of the lexicon.

    Words over :data:`LABEL` letters, and words made of lexicon words, are left out; each lexicon word counts
    as often as one in ten thousand, at least once.
    """
    lexicon = sorted({*LEXICON, *seeds})
    # host components with more than one run of letters, each run by itself
    parts = F.flatten(F.transform(F.split("host", r"\."), lambda c: F.when(F.size(_runs(c)) > 1, _runs(c)).otherwise(F.array().cast("array<string>"))))
    found = pages.select(F.explode(F.concat("words", _runs(F.lower("path"), 2), parts)).alias("word"))
    made_up = F.col("word").rlike("^(?:" + "|".join(lexicon) + "){2,}$") & ~F.col("word").isin(*lexicon)
    counts = found.where((F.length("word") <= LABEL) & ~made_up).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "url-standing")
    floor = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // 10_000)
    more = pages.sparkSession.createDataFrame([(w, floor) for w in lexicon], "word string, n long")
    return counts.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))


def split_label(label: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest cut of a label into words (Viterbi); of equal ones, that with the longer last word.

    ``costs`` are negative log probabilities of known words; an unknown word costs ``unknown`` and 3 a letter.
    A label is cut only if all its parts are known; else it is one word.
    """
    n = len(label)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end):
            cost = best[start] + costs.get(label[start:end], unknown + 3 * (end - start))
            if cost < best[end] - 1e-12:
                best[end], back[end] = cost, start
    out, at = [], n
    while at:
        out.append(label[back[at] : at])
        at = back[at]
    return out[::-1] if all(w in costs for w in out) else [label]


def _splits(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    unknown = math.log(total + 1) + 2
    for b in batches:
        cut = []
        for label, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            costs = {x["word"]: math.log(total) - math.log(x["n"]) for x in found or []}
            cut.append(split_label(label, costs, unknown) if len(label) <= LABEL else [label])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.list_(pa.string()))], names=["label", "cut"])


def label_words(hosts: DataFrame, standing: DataFrame) -> DataFrame:
    """``label, cut`` of every different label (run of letters) of ``hosts`` (host), cut into words."""
    labels = materialize(hosts.select(F.explode(_runs(F.col("host"))).alias("label")).distinct(), "url-labels")
    total = standing.agg(F.sum("n")).first()[0]
    starts = F.explode(F.sequence(F.lit(1), F.length("label")))
    pieces = labels.where(F.length("label") <= LABEL).select("label", starts.alias("a")).select("label", F.explode(F.expr("transform(sequence(1, length(label) - a + 1), n -> substring(label, a, n))")).alias("word"))
    found = pieces.distinct().join(standing, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    known = labels.join(found, "label", "left").select("label", "found")
    return known.mapInArrow(partial(_splits, total=total), "label string, cut array<string>")


def host_words(hosts: DataFrame, standing: DataFrame) -> DataFrame:
    """``host, words`` of every different host."""
    hosts = hosts.select("host").distinct()
    runs = hosts.select("host", F.posexplode(_runs(F.col("host"))).alias("at", "label"))
    cut = runs.join(label_words(hosts, standing), "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "cut"))).alias("cuts"))
    return hosts.join(cut, "host", "left").select("host", F.coalesce(F.flatten("cuts.cut"), F.array().cast("array<string>")).alias("host_words"))


def token_odds(urls: DataFrame, seeds: tuple[str, ...] = SEEDS, seed_odds: float = SEED_ODDS) -> tuple[DataFrame, int]:
    """(``token, odds`` of every token, prior odds), in units of a billionth, of unwanted against wanted.

    ``urls`` has ``tokens, wanted, unwanted``: how many pages of each kind have these tokens.  Add-one
    smoothing over all different tokens; the prior is that of the pages, one more of each kind.
    """
    each = urls.select(F.explode("tokens").alias("token"), "wanted", "unwanted")
    counts = materialize(each.groupBy("token").agg(F.sum("wanted").alias("good"), F.sum("unwanted").alias("bad")), "url-tokens")
    good, bad, names = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    wanted, unwanted = urls.agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.coalesce(F.sum("unwanted"), F.lit(0))).first()
    odds = F.log((F.col("bad") + 1) / F.lit(bad + names + 1)) - F.log((F.col("good") + 1) / F.lit(good + names + 1))
    odds = odds + F.when(F.col("token").isin(*seeds), F.lit(float(seed_odds))).otherwise(F.lit(0.0))
    prior = round(UNIT * math.log((unwanted + 1) / (wanted + 1)))
    return counts.select("token", F.round(odds * UNIT).cast("long").alias("odds")), prior


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, evidence: str | None = None, seeds: tuple[str, ...] = SEEDS, seed_odds: float = SEED_ODDS
) -> DataFrame:
    """``page_id, host, path, rule, verdict, words, score, evidence, held_out`` of every row of ``pages``.

    ``pages`` has ``page_id, url, html`` (without ``html``: no texts); ``evidence`` names a boolean column of
    its own that says which pages are unwanted (null: not known), in place of the text's.  The verdict is
    the longest fitting rule's, else block where the log odds ``score`` are above 0.  A null url, or one
    without ``://``, has empty parts and no tokens, fits no rule, and its odds are the prior's alone.
    Pages whose id's crc32 is a multiple of 5 are held out: their evidence is not used.  Rows without id
    and repeated rows are judged each; a null html has no words.
    """
    columns = {c.lower() for c in pages.columns}
    html = F.col("html") if "html" in columns else F.lit(None).cast("string")
    given = F.col(f"`{evidence}`").cast("boolean") if evidence else F.lit(None).cast("boolean")
    held = F.coalesce(F.crc32(F.col("page_id").cast("string")) % 5 == 0, F.lit(False))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), given.alias("evidence"), held.alias("held_out"))
    rows = materialize(with_parts(rows).withColumn("words", page_words(F.col("html"))).drop("html", "url"), "url-texts")
    standing = materialize(standing_words(rows.select("host", "path", "words"), seeds), "url-words")
    told = F.col("evidence") if evidence else content_evidence(F.col("words"))
    rows = rows.select("page_id", "host", "path", _runs(F.lower("path"), 2).alias("path_words"), told.alias("evidence"), "held_out")
    rows = materialize(rows, "url-rows")
    # equal hosts and path words are one url from here on, so hosts with many pages weigh little
    learn = F.col("evidence").isNotNull() & ~F.col("held_out")
    kinds = [F.coalesce(F.sum(F.when(learn & e, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, e in (("wanted", ~F.col("evidence")), ("unwanted", F.col("evidence")))]
    urls = rows.groupBy("host", "path_words").agg(*kinds)
    urls = urls.join(host_words(rows.select("host"), standing), "host").withColumn("tokens", F.concat("host_words", "path_words"))
    urls = materialize(urls, "url-kinds")
    odds, prior = token_odds(urls, seeds, seed_odds)
    sums = urls.select("host", "path_words", F.explode("tokens").alias("token")).join(odds, "token").groupBy("host", "path_words").agg(F.sum("odds").alias("odds"))
    scored = urls.join(sums, ["host", "path_words"], "left").select("host", "path_words", F.array_join("host_words", " ").alias("words"), ((F.coalesce("odds", F.lit(0)) + prior) / UNIT).alias("score"))
    rule, verdict = rule_of(rules)
    return rows.join(scored, ["host", "path_words"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score", "evidence", "held_out"
    )
