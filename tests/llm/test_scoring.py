import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeflow.llm import decontamination as D, language_id as L
from cladeflow.llm.queries import QUERIES
from cladeflow.runtime import Scratch

from .cases import awkward, documents
from .test_join_packing import brute_classes, check_places
from .test_native import brute_dedup


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def smith_waterman(item, text):
    best, last = 0, [0] * (len(text) + 1)
    for w in item:
        row = [0]
        for j, x in enumerate(text, 1):
            row.append(max(0, last[j - 1] + (2 if w == x else -1), last[j] - 1, row[-1] - 1))
        best, last = max(best, *row), row
    return best / (2 * len(item))


def brute_leaks(docs, items, n=3, least=0.5):
    out = []
    for d, t in docs:
        ws = words(t)
        have = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i, it in items:
            iw = words(it)
            if len(iw) >= n and any(tuple(iw[k : k + n]) in have for k in range(len(iw) - n + 1)):
                score = smith_waterman(iw, ws)
                if score >= least or score * len(iw) >= 13:
                    out.append((d, i, round(score, 9)))
    return sorted(out, key=str)


def test_alignment_matches_brute_force():
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        item = [rng.randrange(2, 9) for _ in range(rng.randint(1, 25))]
        pairs.append((np.array(item, np.uint64), np.array([rng.randrange(2, 9) for _ in range(rng.randint(1, 40))], np.uint64)))
    assert np.allclose(D.align(pairs), [smith_waterman(a.tolist(), b.tolist()) * len(a) for a, b in pairs])


def edited(rng, ws, share):
    out = []
    for w in ws:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["changed"] if x < share else [w]
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(12, 50)))) for i in range(12)] + [(50, "two words"), (51, None), (52, "")]
    docs = []
    for d in range(150):
        ws = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        if d % 3 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = edited(rng, words(items[d % 12][1]), rng.choice([0, 0.05, 0.1, 0.15]))
        docs.append((d, " ".join(ws).upper() if d % 2 else ",\n".join(ws)))
    docs += [(None, items[0][1]), (7, None), (8, "")]
    got = D.matches(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), Scratch(spark, "t")).collect()
    want = brute_leaks(docs, items)
    assert sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in got), key=str) == want
    assert len(want) >= 45


def test_leaks_blocks_and_awkward(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 1)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "lorem ipsum dolor sit amet"), (2, "absent words only here")], "item_id bigint, text string")
    docs = awkward(spark)
    got = D.matches(docs, items, Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 1), ("12", 1), ("2", 1), ("6", 1), ("6", 1), ("7", 1), ("8", 1), ("None", 1)]
    left = D.drop_leaks(docs, items, Scratch(spark, "t"))
    assert left.columns == docs.columns
    assert left.count() == docs.count() - 8
    assert D.matches(docs, items.limit(0), Scratch(spark, "t")).count() == 0
    assert D.matches(docs.limit(0), items, Scratch(spark, "t")).count() == 0


def brute_languages(rows):
    """Posteriors by loops and dicts of (doc_id, text, declared, host, label), fitted on all labelled rows."""

    def bins(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
        grams = [b[i : i + 3] for i in range(len(b) - 2) if b[i + 1] != 32]
        return [(int.from_bytes(g, "big") * 2654435761 % 2**32) >> 16 for g in grams], sum(c != 32 for c in b)

    names = sorted({x for *_, x in rows if x is not None})
    langs = range(len(names))
    seen = {x: collections.Counter() for x in names}
    for _, text, *_, label in rows:
        if label is not None and text is not None:
            seen[label].update(bins(text)[0])
    total = {x: sum(c.values()) + L.BINS / 2 for x, c in seen.items()}
    beliefs, hosts, says = [], collections.defaultdict(lambda: [0.0] * len(names)), collections.defaultdict(lambda: [0.0] * len(names))
    for _, text, declared, host, _ in rows:
        own, letters = bins(text)
        scale = min(len(own), L.EVIDENCE) / max(len(own), 1)
        ll = [scale * sum(math.log((seen[x][g] + 0.5) / total[x]) for g in own) for x in names]
        suffix = host.rpartition(".")[2] if host and "." in host and host.rpartition(".")[2].isalpha() else None
        beliefs.append((ll, letters, suffix))
        if own:
            e = [math.exp(x - max(ll)) for x in ll]
            for k in langs:
                hosts[suffix, host][k] += e[k] / sum(e)
                says[declared][k] += e[k] / sum(e)
    whole = [1.0 + sum(p[k] for p in hosts.values()) for k in langs]
    whole = [x / sum(whole) for x in whole]
    smooth = lambda own, prior: [(own[k] + L.STRENGTH * prior[k]) / (sum(own) + L.STRENGTH) for k in langs]
    above = {s: smooth([sum(p[k] for (x, _), p in hosts.items() if x == s) for k in langs], whole) for s in {s for s, _ in hosts}}
    prior = {key: smooth(own, above[key[0]]) for key, own in hosts.items()}
    totals = [sum(p[k] for p in says.values()) for k in langs]
    out = []
    for (doc_id, _, declared, host, _), (ll, letters, suffix) in zip(rows, beliefs, strict=True):
        own = says.get(declared)
        share = sum(own or [0]) / sum(totals)
        logs = [ll[k] + math.log(prior.get((suffix, host), whole)[k]) for k in langs]
        if own:
            logs = [logs[k] + math.log((own[k] + L.STRENGTH * share + 1e-6) / (totals[k] + L.STRENGTH + 1e-6)) for k in langs]
        best = max(langs, key=lambda k: logs[k])
        posterior = 1 / sum(math.exp(x - logs[best]) for x in logs)
        out.append((doc_id, names[best] if letters else "und", posterior if letters else 0.0, letters > 0 and posterior >= L.MIN_POSTERIOR))
    return out


def check_languages(got, want):
    assert len(got) == len(want)
    for r, (doc_id, language, posterior, accepted) in zip(sorted(got, key=lambda r: r.doc_id), sorted(want), strict=True):
        assert r.doc_id == doc_id and r.posterior == pytest.approx(posterior, abs=1e-3)
        if abs(posterior - 0.5) > 0.01:
            assert (r.language, r.accepted) == (language, accepted)


def test_languages_match_brute_force(spark, sf):
    """The registered query: at this size every labelled row is in the classifier's sample."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert max(collections.Counter(r.lang for r in docs).values()) <= L.SAMPLE_ROWS
    want = brute_languages([(r.doc_id, r.text, r.lang, r.source, r.lang) for r in docs])
    check_languages(QUERIES["op1_language_id"](spark, sf).collect(), want)


def test_languages_of_pages_match_brute_force(spark):
    """Web pages: hosts with suffixes, languages declared in the markup, few labelled rows, misleading declarations."""
    words_ = {"en": "the and of that with this from", "de": "der und die nicht mit von das", "nl": "de en het niet met van dat"}
    rng = random.Random(21)
    rows = []
    for i in range(360):
        truth = rng.choice(["en", "de", "nl"])
        text = " ".join(rng.choices(words_[truth].split(), k=rng.choice([1, 2, 3, 12])))
        said = rng.choice([truth, truth, truth, "en", None])
        host = rng.choice([f"{rng.choice('abc')}.example.{dict(en='com', de='de', nl='nl')[truth]}", "shared.example.com", "localhost"])
        rows.append((i, text, said, host, truth if i % 3 == 0 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, said string, host string, label string")
    html = F.concat(F.coalesce(F.concat(F.lit('<html lang="'), "said", F.lit('">')), F.lit("<html>")), F.lit("<p>"))
    df = df.withColumn("html", html).withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/p?q")))
    got = L.identify(df, Scratch(spark, "t"), F.col("doc_id"), F.col("text"), L.markup_language(F.col("html")), L.host_of(F.col("url")), F.col("label"))
    check_languages(got.collect(), brute_languages(rows))


def test_long_texts_are_read_in_pieces(spark):
    """Two texts beyond a piece, one of them five times the size, and one that ends just past a cut."""
    rng = random.Random(31)
    lexicon = {"en": "the and of that with this from", "de": "der und die nicht mit von das"}
    text = lambda lang, n: " ".join(rng.choices(lexicon[lang].split(), k=n))
    rows = [(i, text(x, 20), x, "src", x) for i in range(30) for x in ("en", "de")]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(100, text("en", L.PIECE // 20) + text("de", L.PIECE // 2), None, "src", None), (101, text("de", L.PIECE // 3)[: L.PIECE + 1], None, "src", None)]
    assert len(rows[-2][1]) > 1.5 * L.PIECE and len(rows[-1][1]) == L.PIECE + 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, said string, host string, label string")
    got = L.identify(df, Scratch(spark, "t"), F.col("doc_id"), F.col("text"), F.col("said"), F.col("host"), F.col("label"))
    check_languages(got.collect(), brute_languages(rows))


def test_language_held_out(spark):
    """Labels of a fifth of the rows are hidden, and some declarations are wrong."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("truth", F.col("lang"))
    hidden = F.pmod("doc_id", F.lit(5)) == 0
    docs = docs.withColumn("lang", F.when(~hidden, F.col("lang"))).withColumn("said", F.when(F.pmod("doc_id", F.lit(10)) == 0, F.lit("en")).otherwise(F.col("lang")))
    got = L.identify(docs, Scratch(spark, "t"), F.col("doc_id"), F.col("text"), F.col("said"), F.col("source"), F.col("lang"))
    both = got.join(docs.select("doc_id", "truth"), "doc_id").where(F.pmod("doc_id", F.lit(5)) == 0)
    right, all_rows = both.where("truth = language").count(), both.count()
    assert all_rows == 200 and right >= 190


def test_language_evidence_decides_between_equal_texts(spark):
    rows = []
    for i in range(300):
        lang, words_ = [("en", "the and of that with"), ("de", "der und die nicht mit")][i % 2]
        rows.append((i, " ".join(random.Random(i).choices(words_.split(), k=30)), lang, "https://a.example.%s/x" % lang, 1))
    rows += [(1000, "in", None, "https://a.example.de/y", 1), (1001, "in", None, "https://a.example.en/y", 1)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in L.of_documents(docs, Scratch(spark, "t")).collect()}
    assert got[1000].language == "de" and got[1001].language == "en"
    assert all(got[r[0]].language == r[2] for r in rows[:300])


def test_every_labelled_language_is_fitted(spark):
    """Seventy languages, each of words of its own; the last ones have the fewest rows."""
    rng = random.Random(4)
    lexicon = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(70)]
    rows = [(100 * k + i, " ".join(rng.choices(lexicon[k], k=30)), f"l{k:02d}", "src", 1) for k in range(70) for i in range(4 if k < 64 else 2)]
    got = L.of_documents(documents(spark, rows), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.language for r in got} == {r[0]: r[2] for r in rows} and all(r.accepted for r in got)


def test_markup_and_hosts(spark):
    df = spark.createDataFrame([('<!DOCTYPE html><html class="a" lang="DE-at"><p>', "https://M.Example.org:80/a?b", ), ("<p lang=fr>", "src0")], "html string, url string")
    got = df.select(L.markup_language(F.col("html")), L.host_of(F.col("url")), L.suffix_of(L.host_of(F.col("url")))).collect()
    assert [tuple(r) for r in got] == [("de", "m.example.org", "org"), (None, "src0", None)]


@pytest.mark.parametrize("labelled", [True, False])
def test_language_awkward(spark, labelled):
    docs = awkward(spark) if labelled else awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    got = L.of_documents(docs, Scratch(spark, "t")).collect()
    assert len(got) == docs.count()
    if labelled:
        assert {r.accepted for r in got if r.doc_id in (3, 4, 5)} == {False}
        assert all(r.language == "en" for r in got if r.doc_id in (1, 2, 6, 7, 8))
    else:
        assert all(r.accepted and r.language is None for r in got)
    left = L.keep_identified(docs, Scratch(spark, "t"))
    assert left.columns == docs.columns and left.count() == sum(r.accepted for r in got)
    assert L.of_documents(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_pipeline_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = {r.doc_id for r in QUERIES["op1_language_id"](spark, sf).collect() if r.accepted}
    docs = [r for r in docs if r[0] in kept]
    stay = {d for d, _, _, k, _ in brute_dedup(docs) if k}
    docs = [r for r in docs if r[0] in stay]
    classes = {c for _, n, c in brute_classes(docs, 5, 80) if n} | {d for d, n, _ in brute_classes(docs, 5, 80) if not n}
    docs = [r for r in docs if r[0] in classes]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _, _ in brute_leaks(docs, items)}
    want = {r[0] for r in docs if r[0] not in leaks}
    got = corpus_pipeline.run(spark, sf).collect()
    assert leaks and {r.doc_id for r in got} == want
    check_places(got)


def test_pipeline_stages_keep_the_columns(spark, sf, tmp_path):
    docs = awkward(spark).withColumn("node", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("count", F.lit(None).cast("string"))
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == docs.columns
        corpus_pipeline.pack_sequences(spark, rows, sf).count()
