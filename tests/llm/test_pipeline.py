import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from stemma.llm.packing import VOCABULARY, WordEncoder, public_tokenizers
from stemma.llm.queries import LLM_ORACLE, LLM_QUERIES
from stemma.llm.simhash_dedup import fingerprint
from stemma.llm.tables import table
from stemma.session import cut_lineage

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in LLM_QUERIES}
    assert set(LLM_QUERIES) < set(names) and "pipeline" in names and set(LLM_ORACLE) <= set(__spark_entry__.oracle_sql())


def near_classes(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def stages(spark):
    docs = cut_lineage(table(spark, SF_DIR, "documents").unionByName(table(spark, SF_DIR, "documents").limit(20)))
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(cut_lineage(stage(spark, made[-1], SF_DIR)))
    return made


def test_filters_keep_clean_documents(spark, stages):
    labels = {r.doc_id: r for r in table(spark, SF_DIR, "labels").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in stages[:2])
    gone = before - after
    assert gone and all(labels[i].quality == 0 for i in gone if i in labels)
    assert [c for c in stages[2].columns] == [c for c in stages[0].columns]
    gone = after - {r.doc_id for r in stages[2].collect()}
    assert all(labels[i].toxic == 1 for i in gone if i in labels)


def test_duplicates_and_packing_match_plain_versions(stages):
    rows = [(r.doc_id, r.text or "") for r in stages[2].collect()]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text), []).append((-len(text), doc_id, text))
    exact = sorted((min(g)[1], min(g)[2]) for g in groups.values())
    assert sorted((r.doc_id, r.text) for r in stages[3].collect()) == exact

    found = near_classes([fingerprint(t.encode()) for _, t in exact])
    least = {}
    for (doc_id, text), c in zip(exact, found):
        least[c] = min(least.get(c, (doc_id, text)), (doc_id, text))
    near = sorted(least.values())
    assert sorted((r.doc_id, r.text) for r in stages[4].collect()) == near

    encoder = WordEncoder(public_tokenizers.path(VOCABULARY))
    tokens = Counter()
    for r in stages[5].collect():
        tokens[r.doc_id] += r.length
    assert tokens == Counter({i: len(encoder.encode(t)) // 4 + 1 for i, t in near})


CLASHING = "good int, score string, key int, sha int, row int, piece int, fp int, _id int, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and very long texts, equal rows, and columns named as the operators name theirs."""
    texts = [r.text for r in table(spark, SF_DIR, "documents").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "web", 1), (None, None, None, None, None), (7, texts[7], "en", "web", 2), rows[9], rows[9]]
    rows += [(900, "", "en", "web", 0), (901, None, "en", None, 0), (902, "river and mountain " * 30_000, "en", "web", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return cut_lineage(spark.createDataFrame([(*r, *[1] * 9) for r in rows], f"{schema}, {CLASHING}"))


def test_stages_take_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, SF_DIR))
        assert after.columns == odd.columns, name
        before, left = (Counter(map(repr, x.collect())) for x in (docs, after))
        assert not left - before, name
        if name == "exact_dedup":
            plain = {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in docs.collect()}
            assert sum(left.values()) == len(plain)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    encoder = WordEncoder(public_tokenizers.path(VOCABULARY))
    assert sum(r.length for r in packed) == sum(len(encoder.encode(r.text or "")) // 4 + 1 for r in docs.collect())
    assert docs.where("doc_id = 902").count() == 1


def test_stages_take_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), SF_DIR).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SF_DIR).collect() == []
