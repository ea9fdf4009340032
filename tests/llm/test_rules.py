from tidemark.llm import rules

from .brute import base_figures

SENTENCE = "The quick brown fox jumps over the lazy dog near the quiet river bank today. "
TEXTS = [
    SENTENCE + "Another one follows it with different words and a calm ending.",
    SENTENCE * 3,
    "",
    None,
    "short text",
    " ".join(f"word{k}###" for k in range(40)),
    "\n".join(["SHOUTING!! AT!! EVERY!! READER!! OF!! THIS!! PAGE!! IS!! RUDE!! INDEED!! TODAY!!"] * 1),
    "same line here\nsame line here\n\nsame line here\nother \t\x0b words",
    " ".join("one one one two two two three three three four four four".split()),
    "long " + " ".join(f"word{k}x" for k in range(20_000)),
]
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_figures_match_brute_force(make):
    rows = {r.doc_id: r for r in rules.apply_rules(make(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = base_figures(text)
        assert tuple(rows[i][n] for n in NAMES) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert rows[i].base_failed == failed
        assert not (failed and rows[i].kept)
    assert rows[0].kept and rows[9].kept
    assert not rows[5].kept and not rows[6].kept and not rows[8].kept


def test_order_does_not_change_verdicts():
    forward = rules.standard_rules()
    for text in TEXTS:
        f = rules.measure(text)
        assert rules._kept(f, forward) == rules._kept(f, forward[::-1])


def test_rules_that_reject_more_for_less_come_first():
    slow = rules.Rule("slow", lambda f: sum(range(20_000)) < 0)
    good = rules.Rule("good", lambda f: True)
    assert [r.name for r in rules.order_rules(TEXTS, [slow, good])] == ["good", "slow"]
    assert [r.name for r in rules.order_rules([], [slow, good])] == ["slow", "good"]


def test_kept_rows_keep_their_columns(spark):
    rows = [(1, TEXTS[0], 5, None), (2, None, 6, "x"), (3, TEXTS[0], 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, n_words string")
    kept = rules.keep_documents(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    assert rules.keep_documents(docs.filter("doc_id > 5")).count() == 0
    assert rules.apply_rules(docs.filter("doc_id > 5")).count() == 0
