"""Every stage of the pipeline against a plain version over its own input."""

from collections import Counter

import corpus_pipeline
from flightseal.llm import quality
from flightseal.session import materialize
from tests.conftest import SF
from tests.llm.test_packing import check
from tests.llm.test_quality import plain
from tests.llm.test_repeats import plain_removed
from tests.llm.test_simhash import plain_groups, plain_print


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mix", "best_fit_packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    step = lambda name, docs: materialize(stages[name](spark, docs, SF), name)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = step("quality_rules", source)
    kept = {r.doc_id for r in quality.judge(source, labels).where("kept").collect()}
    assert texts(good) == {i: t for i, t in texts(source).items() if i in kept}
    for text in texts(good).values():
        n, *_, repeated = plain(text)
        assert n >= 10 and 100 * repeated <= 20 * n
    fine = {r.doc_id for r in labels.where("quality = 1").collect()}
    passed = {r.doc_id for r in quality.judge(source, labels).where("not base_failed").collect()}
    assert len(fine & passed & kept) >= 0.99 * len(fine & passed)

    single = step("simhash_near_dedup", good)
    groups = plain_groups({i: plain_print(t) for i, t in texts(good).items()})
    assert texts(single) == {i: t for i, t in texts(good).items() if groups[i] == i}

    clean = step("suffix_array_dedup", single)
    before = {i: t.encode() for i, t in texts(single).items()}
    gone = plain_removed(before, 100)
    wanted = {i: bytes(b for at, b in enumerate(t) if at not in gone[i]).decode("utf-8", "ignore") for i, t in before.items()}
    assert texts(clean) == {i: t for i, t in wanted.items() if t}
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mixed = step("source_mix", clean)
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, clean.collect()))
    sizes = Counter()
    for r in mixed.collect():
        sizes[r.source] += len(r.text.encode())
    for docs in (good, single, clean, mixed):
        assert docs.columns == source.columns

    packed = step("best_fit_packing", mixed).collect()
    check(packed, 2048)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
