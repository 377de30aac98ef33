import random
import re

import pytest

from cladeflow.llm import license_scan as L
from cladeflow.llm.queries import QUERIES

from .cases import awkward, documents


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, docs):
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in rows) == sorted((str(d), *brute(t)) for d, t in docs) or sorted(
        ((str(r.doc_id), *tuple(r)[1:6]) for r in rows), key=str
    ) == sorted(((str(d), *brute(t)) for d, t in docs), key=str)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.base_labels)


def test_whole_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op5_license_scan"](spark, sf).collect()
    check(rows, docs)
    assert sum(r.n_base for r in rows) > 0


def test_templates_and_their_edits(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(["alpha", "license", "the", "of", "copy", "source", "naïve", "file"]) for _ in range(n))
    docs, want = [], {}
    for label, text, key in L.TEMPLATES:
        docs.append((len(docs), fill(rng.randint(0, 60)) + " " + text.upper().replace(" ", ", ", 3) + "\n" + fill(30)))
        want[docs[-1][0]] = label
        words = text.split()
        words.insert(len(words) - 1 if text.startswith(key) else 1, "really")  # outside the key phrase
        docs.append((len(docs), fill(20) + " " + " ".join(words)))
        want[docs[-1][0]] = label
    for _ in range(20):
        docs.append((len(docs), fill(300)))
    docs += [(900, "MIT-License mit license, Apache\nLicense cc-by CC BY gnu general public license2 x"), (901, "mit"), (902, "license apache")]
    rows = L.scan(documents(spark, docs).repartition(3)).collect()
    check(rows, docs)
    for r in rows:
        if r.doc_id in want:
            assert want[r.doc_id] in r.labels.split(",") and r.score >= L.COVERAGE
        elif r.doc_id < 900:
            assert r.labels == "" and r.score == 0


@pytest.mark.parametrize("empty", [False, True])
def test_awkward(spark, empty):
    docs = awkward(spark).limit(0) if empty else awkward(spark)
    check(L.scan(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
