"""Operator 10: URL filters by rules, and by naive Bayes on the words of host and path.

Host and path are cut out of the url with column expressions and held against a fixed list of rules. Urls that no rule fits are judged by
multinomial naive Bayes: runs of letters in host and path are split into words by Viterbi over a unigram model, whose counts are those of
all words in the pages' own text, and the words are scored. The counts are a table; only the words that are found within a run go to the driver,
as no other can be part of a split.

Its examples are the urls that rules decide, with the rules' verdicts. The words that the rules themselves name (their domains and folders)
are masked in all urls, so that it learns what else such urls have in common, above all the names of their hosts, and not the rules. A short
list of words that name what is blocked anywhere is its prior knowledge: their odds are a stated value at least. Both classes are
held to be as likely, so a url without a word that was seen is allowed.

Cases: a null url or one without ``://`` has an empty host and path, no rule and the verdict allow; a null html adds no words; without urls of both
verdicts only the list is left; rows of an equal page_id, and null ones, each get a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import scratch

#: (host and path, verdict)
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Words that speak for block wherever they stand, and the log odds that each has at least.
LEXICON = ("adult", "betting", "casino", "escort", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
LEAST_ODDS = 3.0
#: Places that hashed words are counted in.
PLACES = 1 << 16
#: First letters by which words are looked up in the runs; any length gives the same words.
FIRST = 25
#: Added to each seen place's count.
SMOOTH = 0.1
MEMORY = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled): ruled is the verdict of the longest rule that fits, or null."""
    part = lambda n: F.coalesce(F.regexp_extract("url", "(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    out = pages.select("page_id", F.translate(part(1), UPPER, UPPER.lower()).alias("host"), part(2).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def runs_of(text: str | None) -> list[str]:
    """Runs of letters and runs of digits, in order."""
    return re.findall(r"[^\W\d_]+|\d+", (text or "").lower())


def _parts(marked: DataFrame) -> DataFrame:
    """(part): the substrings of one to FIRST letters of all runs in hosts and paths."""

    def runs(batches):
        for batch in batches:
            found = {r for i in range(2) for text in batch.column(i).to_pylist() for r in runs_of(text) if not r[0].isdigit()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["run"])

    def cut(batches):
        for batch in batches:
            found: set = set()
            for run in batch.column(0).to_pylist():
                found.update(run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + FIRST) + 1))
                if len(found) > MEMORY:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["part"])
                    found = set()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["part"])

    return marked.select("host", "path").mapInArrow(runs, "run string").distinct().mapInArrow(cut, "part string")


def unigrams(pages: DataFrame, rules=RULES) -> dict[str, float]:
    """Log probabilities, among all words (a-z) in the text of all pages, of those that can be part of a run in a host or path.

    The empty word stands for the rarest of all. A word of over FIRST letters is taken where its first letters are found.
    """

    def run(batches):
        tags, letters = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z]{2,}")
        counts: Counter = Counter()

        def flush():
            rows = [(w.decode(), n) for w, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for html in batch.column(0).to_pylist():
                if html:
                    counts.update(letters.findall(tags.sub(b" ", html).lower()))
            if len(counts) > MEMORY:
                yield flush()
        if counts:
            yield flush()

    counted = scratch.save(pages.select(F.col("html").cast("binary")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    seen, rarest = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.min("n"), F.lit(1))).first()
    used = counted.join(_parts(parsed(pages, rules)), F.substring("word", 1, FIRST) == F.col("part"), "left_semi").toArrow()
    counts = dict(zip(used.column(0).to_pylist(), used.column(1).to_pylist()))
    scratch.drop(counted)
    total = seen + len(LEXICON)
    return {"": math.log(rarest / total), **{w: math.log((counts.get(w, 0) + (w in LEXICON)) / total) for w in {*counts, *LEXICON}}}


class Segmenter:
    """Splits runs of letters into the likeliest words; unknown words cost more the longer they are."""

    #: What an unknown word costs beyond the rarest known one, and what each of its letters does.
    NEW, LETTER = 2.0, 3.0

    def __init__(self, log_p: dict[str, float]):
        self.log_p, self.known = log_p, {}
        self.unknown = min(log_p.values(), default=0.0) - self.NEW
        self.longest = max(map(len, log_p), default=0)

    def split(self, run: str) -> list[str]:
        """The words of a run; of equally likely splits the one whose last word is longest."""
        if (done := self.known.get(run)) is not None:
            return done
        best, back = [0.0], [0]
        lead = 0  # where an unknown word that ends here had best begin
        for end in range(1, len(run) + 1):
            if best[end - 1] + self.LETTER * (end - 1) > best[lead] + self.LETTER * lead:
                lead = end - 1
            at, top = lead, best[lead] + self.unknown - self.LETTER * (end - lead)
            for start in range(max(0, end - self.longest), end):
                p = self.log_p.get(run[start:end])
                if p is not None and (best[start] + p, -start) > (top, -at):
                    at, top = start, best[start] + p
            best.append(top)
            back.append(at)
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known[run] = words[::-1]
        return self.known[run]

    def tokens(self, host: str | None, path: str | None, masked: frozenset = frozenset()) -> list[str]:
        """h: and p: words but those masked, with runs of digits as one token."""
        out = []
        for kind, text in (("h:", host or ""), ("p:", path or "")):
            for run in runs_of(text):
                if run not in masked:
                    out += [kind + "0"] if run[0].isdigit() else [kind + w for w in self.split(run)]
        return out


def named_by(rules) -> frozenset:
    """The words of the rules' own texts."""
    return frozenset(run for text, _ in rules for run in runs_of(text))


def place_of(token: str) -> int:
    return crc32(token.encode()) % PLACES


def odds(counts: np.ndarray, lexicon=LEXICON, least: float = LEAST_ODDS) -> np.ndarray:
    """Log odds of block for each place, from the counts (allow, block) of each; places that neither class nor the lexicon has say nothing."""
    out, seen = np.zeros(PLACES), counts.sum(axis=0) > 0
    if counts.any(axis=1).all():
        smooth = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * seen.sum()))
        out = np.where(seen, smooth[1] - smooth[0], 0.0)
    of_words = [place_of(kind + word) for word in lexicon for kind in ("h:", "p:")]
    out[of_words] = np.maximum(out[of_words], least)
    return out


def train(marked: DataFrame, log_p: dict[str, float], rules=RULES) -> np.ndarray:
    """odds() of the urls that rules decide; marked (host, path, ruled)."""
    masked = named_by(rules)

    def run(batches):
        segmenter, counts = Segmenter(log_p), np.zeros((2, PLACES), np.int64)
        for batch in batches:
            for host, path, ruled in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                own = counts[int(ruled == "block")]
                for t in segmenter.tokens(host, path, masked):
                    own[place_of(t)] += 1
        c, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[c, place])], names=["c", "place", "n"])

    rows = marked.where("ruled IS NOT NULL").select("host", "path", "ruled").mapInArrow(run, "c int, place int, n long").groupBy("c", "place").agg(F.sum("n").alias("n")).collect()  # at most two for each place
    counts = np.zeros((2, PLACES))
    for r in rows:
        counts[r.c, r.place] = r.n
    return odds(counts)


def judged(marked: DataFrame, log_p: dict[str, float], model: np.ndarray, rules=RULES) -> DataFrame:
    """marked (page_id, host, path, rule, ruled) with log_odds of block, null where no word counts."""
    masked = named_by(rules)

    def judge(batches):
        segmenter = Segmenter(log_p)
        for batch in batches:
            scores = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = segmenter.tokens(host, path, masked)
                scores.append(float(sum(model[place_of(t)] for t in tokens)) if tokens else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "log_odds"])

    return marked.mapInArrow(judge, f"page_id {marked.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, ruled string, log_odds double")


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) for each row of pages (page_id, url, html); log_odds is naive Bayes', whether or not a rule fits."""
    marked = parsed(pages, rules)
    log_p = unigrams(pages, rules)
    out = judged(marked, log_p, train(marked, log_p, rules), rules)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
