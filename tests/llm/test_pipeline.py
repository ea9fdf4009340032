import random
from collections import Counter

import public_tokenizers
import pytest

from tidemark.llm import bpe, mixing, rules

from .brute import components, drop_lines, sha, words

pipeline = pytest.importorskip("corpus_pipeline")


def _rows():
    random.seed(11)
    vocabulary = ["".join(random.choices("aeioulnrst", k=random.randint(3, 8))) for _ in range(300)]
    line = lambda n: " ".join(random.choices(vocabulary, k=n))
    shared = "terms of use apply to every page of this site"
    rows = []
    for i in range(80):
        text = "\n".join(line(random.randint(8, 30)) for _ in range(random.randint(1, 5)))
        rows.append([i, text + ("\n" + shared if i % 3 == 0 else ""), "en", f"src{i % 3}"])
    for i in range(80, 95):
        copied = rows[i - 80][1].split(" ")
        copied[-1] = "changed"
        rows.append([i, " ".join(copied), "en", "src1"])
    rows += [[95, None, "en", "src0"], [96, "", "en", None], [97, "word### " * 30, "en", "src2"]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def test_every_stage_on_what_the_one_before_kept(spark, make):
    docs = make(_rows())
    text = {r[0]: r[1] for r in _rows()}

    kept = pipeline.quality_rules(spark, docs, "")
    assert kept.schema == docs.schema
    wanted = {i for i, t in text.items() if rules._kept(rules.measure(t), rules.standard_rules())}
    assert {r.doc_id for r in kept.collect()} == wanted and 97 not in wanted and len(wanted) > 80

    deduped = pipeline.drop_repeated_lines(spark, kept, "")
    lines = drop_lines([(i, text[i]) for i in sorted(wanted)])
    assert deduped.schema == docs.schema
    assert {r.doc_id: r.text for r in deduped.collect()} == {i: x[0] for i, x in lines.items()}
    assert any(x[2] for x in lines.values())

    single = pipeline.drop_near_duplicates(spark, deduped, "")
    heads = {i for i, (_, root) in components([(i, x[0]) for i, x in lines.items()]).items() if i == root}
    assert single.schema == docs.schema and len(heads) < len(wanted)
    assert {r.doc_id for r in single.collect()} == heads

    mixed = pipeline.mix_sources(spark, single, "")
    assert mixed.schema == docs.schema
    total = Counter()
    for r in mixed.collect():
        total[r.doc_id] += len(words(r.text))
    taken = {r.doc_id: r.taken for r in mixing.mix(single).collect()}
    assert {i: n for i, n in total.items() if n} == {i: n for i, n in taken.items() if n}

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in pipeline.tokenize(spark, mixed, "").collect())
    assert got == Counter((r.doc_id, sha(codec.encode(r.text)), sha(r.text)) for r in mixed.collect())


def test_run_equals_its_stages(spark, make, tmp_path):
    docs = make(_rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
    assert Counter(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, step.collect()))


def test_empty_table(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
