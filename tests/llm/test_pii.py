import hashlib
import random
import re

import pytest

from cladeflow.llm import pii
from cladeflow.llm.queries import QUERIES
from cladeflow.runtime import Scratch

from .cases import awkward, documents


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id] or "")
        s = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest(), (r.doc_id, s, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in want) for k in pii.BASE)
        assert set(filter(None, s.split(","))) <= set(r.spans.split(","))


def test_whole_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    check(rows, texts)


def test_base_edges(spark):
    rng = random.Random(2)
    texts = {
        1: "a@b.c_x@d.e a@b@c.d x.y+z%1@sub-1.example.co.uk. @no.at a@b a@b. \U0001f600é me@x.yz",
        2: "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3 12345.1.1.1.1 9.9.9.9x",
        3: "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 5500000000000004 12 3456",
        4: "+1 (555) 010-9999 +123456789 +12 +1234567890123456 ++44 20 7946 0958. +1- +",
        5: "1" * 60000 + " " + "a" * 60000 + " " + "1.2." * 20000 + " " + "9 " * 30000 + "+1" + " " * 40000,
        6: None,
        7: "",
    }
    for i in range(8, 60):
        texts[i] = "".join(rng.choice("0123459.+@ -()ab_") for _ in range(400))
    scratch = Scratch(spark, "t")
    check(pii.report(pii.scan(documents(spark, list(texts.items())), scratch)).collect(), texts)


def test_trees_add_what_context_names(spark):
    rng = random.Random(6)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = {}
    for i in range(400):
        kind = i % 4
        texts[i] = [
            f"please call +{1 + i % 8} {num(3)} {num(3)} {num(4)} today",
            f"her phone {num(3)}-{num(3)}-{num(4)} is new",
            f"order {num(7)} and {num(4)}-{1 + i % 12:02d}-{1 + i % 28:02d} were shipped",
            f"write to user{i} [at] example [dot] org now",
        ][kind]
    rows = pii.report(pii.scan(documents(spark, list(texts.items())), Scratch(spark, "t"))).collect()
    check(rows, texts)
    spans = {r.doc_id: r.spans for r in rows}
    assert sum("phone_loose" in spans[i] for i in range(1, 400, 4)) >= 90
    assert sum("email_hidden" in spans[i] for i in range(3, 400, 4)) >= 90
    assert all(spans[i] == "" for i in range(2, 400, 4))


def test_rare_kinds_are_calibrated_whatever_the_sample(spark, monkeypatch):
    """National ids among very many phones: a sample drawn by label alone has about one."""
    monkeypatch.setattr(pii, "SAMPLE", 400)
    rng = random.Random(9)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = {i: f"her phone {num(3)}-{num(3)}-{num(4)} is new" for i in range(4000)}
    texts |= {i: f"order {num(7)} and {num(4)}-{1 + i % 12:02d}-{1 + i % 28:02d} were shipped" for i in range(4000, 5000)}
    texts |= {i: f"the ssn {num(3)}-{num(2)}-{num(4)} was named" for i in range(5000, 5030)}
    spans = {r.doc_id: r.spans for r in pii.report(pii.scan(documents(spark, list(texts.items())), Scratch(spark, "t"))).collect()}
    assert all("national_id" in spans[i] for i in range(5000, 5030))
    assert sum("phone_loose" in spans[i] for i in range(4000)) >= 3900
    assert all(spans[i] == "" for i in range(4000, 5000))


@pytest.mark.parametrize("empty", [False, True])
def test_awkward(spark, empty):
    docs = awkward(spark).limit(0) if empty else awkward(spark)
    rows = pii.report(pii.scan(docs, Scratch(spark, "t"))).collect()
    assert len(rows) == docs.count() and all(r.spans == "" for r in rows)
