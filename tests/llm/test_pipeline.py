"""The corpus pipeline, stage by stage, against plain versions."""

import hashlib
import re

import pytest

import corpus_pipeline
from quadrille.llm import near_dedup, quality_rules
from quadrille.llm.common import load, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = load(spark, small, "documents"), {}
    out["input"] = docs
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = stored(f(spark, docs, small), name)
    return out


def test_columns(stages):
    for name in ("quality_rules", "near_dedup", "suffix_dedup", "mixing"):
        assert stages[name].columns == COLUMNS


def test_quality(spark, small, stages):
    kept = {r.doc_id for r in quality_rules.op6_quality_rules(spark, small).where("kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"].collect()} == kept


def test_one_of_each_class(stages):
    cls = {r.doc_id: r.class_id for r in near_dedup.classes(stages["quality_rules"]).collect()}
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted(set(cls.values()))


def test_repeats_are_cut(stages):
    before = {r.doc_id: r for r in stages["near_dedup"].collect()}
    first, want = set(), {}
    for i in sorted(before):
        b = before[i].text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in first:
                gone[k : k + 100] = b"\1" * 100
            first.add(w)
        chars, at = [], 0
        for c in before[i].text:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                chars.append(c)
            at += size
        want[i] = "".join(chars)
    for r in stages["suffix_dedup"].collect():
        assert (r.text, r.n_chars, r.lang, r.source) == (want[r.doc_id], len(want[r.doc_id]), before[r.doc_id].lang, before[r.doc_id].source)


def test_mix_and_tokens(spark, small, stages):
    docs = {r.doc_id: r for r in stages["suffix_dedup"].collect()}
    mixed = stages["mixing"].collect()
    assert {r.doc_id for r in mixed} <= set(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(size(r.text) for r in docs.values())
    assert abs(sum(size(r.text) for r in mixed) - 1.5 * total) < 0.1 * total
    tokens = stages["byte_bpe"].collect()
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)
    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest() for r in tokens)


def test_run_is_the_stages(spark, small, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, stages["byte_bpe"].collect()))


def test_stages_on_odd_rows(spark, small, odd_docs):
    """What each stage keeps of odd rows follows from the stage before by plain rules."""
    own = odd_docs.select(*COLUMNS)
    empty = _odd(spark, small, own.limit(0))
    assert all(df.isEmpty() for df in empty.values()) and all(empty[n].columns == COLUMNS for n in list(empty)[:-1])
    rows = {name: df.collect() for name, df in _odd(spark, small, own).items()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert all(len(words(r.text)) >= 10 for r in rows["quality_rules"])
    assert len({r.text for r in rows["near_dedup"]}) == len(rows["near_dedup"]) <= len(rows["quality_rules"])
    assert sorted(str(r.doc_id) for r in rows["suffix_dedup"]) == sorted(str(r.doc_id) for r in rows["near_dedup"])
    assert all(r.n_chars == len(r.text) for r in rows["suffix_dedup"])
    counts = {}
    for r in rows["mixing"]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(n <= 2 for k, n in counts.items() if k is not None) and set(counts) <= {r.doc_id for r in rows["suffix_dedup"]}
    assert sorted(r.decoded_sha256 for r in rows["byte_bpe"]) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows["mixing"])


def _odd(spark, small, docs):
    out = {}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = stored(f(spark, docs, small), name)
    return out
