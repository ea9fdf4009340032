"""Quality rules as a short-circuit cascade.

Every text gets the base figures. Texts that pass the base limits go through a list of further
rules; a text leaves at the first rule that rejects it. All rules must pass for a text to be
kept, so their order changes only the cost. It is chosen from a sample: each rule is timed and
counted on texts that passed the base limits, and rules run by rejections per second.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, lean, texts

# Fixed by the contract of the base figures.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

# The sample that orders the rules: at most so many texts, a seeded share of the rows.
SAMPLE_ROWS = 2_000
SAMPLE_SHARE = 0.05
SAMPLE_SEED = 8


@dataclass
class Figures:
    """The base figures of one text and what the rules may look at."""

    text: str
    words: list[bytes] = field(repr=False)
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0

    @property
    def base_failed(self) -> bool:
        return (
            self.n_words < LEAST_WORDS
            or 100 * self.n_repeat_words > MOST_REPEATED_PERCENT * self.n_words
        )


def _repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five found at least twice."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, reach = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + WINDOW - max(start, reach)
            reach = start + WINDOW
    return covered


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> Figures:
    """Base figures of a text; null has no words."""
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the six ASCII spaces
    return Figures(
        text=text,
        words=words,
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, SPACE)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=_repeated_lines(text),
        n_repeat_words=_repeated_words(words),
    )


@dataclass(frozen=True)
class Rule:
    """A named test that is true for texts to reject."""

    name: str
    rejects: Callable[[Figures], bool]


CAPITAL = regex.compile(r"\p{Lu}")
LETTER = regex.compile(r"\p{L}")
DIGIT = regex.compile(r"\p{N}")
DOUBLE_MARK = regex.compile(r"[!?]{2,}")
WORD_WITH_LETTER = regex.compile(rb"[A-Za-z\x80-\xff]")


def standard_rules(
    *,
    most_symbols: float = 0.1,
    word_length: tuple[float, float] = (2.0, 14.0),
    most_repeated_lines: float = 0.5,
    most_capitals: float = 0.4,
    most_digits: float = 0.5,
    most_marks: float = 0.1,
    least_lettered: float = 0.6,
    most_stutter: float = 0.3,
) -> list[Rule]:
    """The usual rules on web text; every limit is a parameter, shares are of words or letters."""

    def word_lengths(f: Figures) -> bool:
        low, high = word_length
        return not low * f.n_words <= f.word_chars <= high * f.n_words

    def repeated_lines(f: Figures) -> bool:
        return f.n_dup_lines > most_repeated_lines * (f.text.count("\n") + 1)

    def capitals(f: Figures) -> bool:
        letters = len(LETTER.findall(f.text))
        return len(CAPITAL.findall(f.text)) > most_capitals * letters

    def lettered(f: Figures) -> bool:
        return sum(map(bool, map(WORD_WITH_LETTER.search, f.words))) < least_lettered * f.n_words

    def stutter(f: Figures) -> bool:
        same = sum(a == b for a, b in zip(f.words, f.words[1:]))
        return same > most_stutter * f.n_words

    return [
        Rule("symbols", lambda f: f.n_symbols > most_symbols * f.n_words),
        Rule("word_length", word_lengths),
        Rule("repeated_lines", repeated_lines),
        Rule("capitals", capitals),
        Rule("digits", lambda f: len(DIGIT.findall(f.text)) > most_digits * f.word_chars),
        Rule("marks", lambda f: len(DOUBLE_MARK.findall(f.text)) > most_marks * f.n_words),
        Rule("lettered", lettered),
        Rule("stutter", stutter),
    ]


def order_rules(sample: Iterable[str | None], rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejections per second on ``sample``, each tried on every text past the base.

    Ties, and rules on an empty sample, keep the given order.
    """
    figures = [f for f in map(measure, sample) if not f.base_failed]
    gains = []
    for rule in rules:
        started = time.perf_counter()
        rejected = sum(map(rule.rejects, figures))
        gains.append(rejected / max(time.perf_counter() - started, 1e-9))
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -gains[k])]


def draw_sample(documents: DataFrame, text_col: str = "text") -> list[str | None]:
    """At most ``SAMPLE_ROWS`` seeded sample texts; the scan stops once it has them."""
    drawn = documents.select(F.col(text_col).cast("string")).sample(SAMPLE_SHARE, SAMPLE_SEED)
    return [row[0] for row in drawn.limit(SAMPLE_ROWS).collect()]


def _kept(f: Figures, rules: Sequence[Rule]) -> bool:
    return not f.base_failed and not any(rule.rejects(f) for rule in rules)


def apply_rules(
    documents: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base figures and the verdict of every whole text, one row per input row.

    Columns: id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept``. Null and empty texts have no words and fail the base limits. Other columns are not
    read, so their names do not matter; repeated rows get repeated verdicts.
    """
    ordered = order_rules(draw_sample(documents, text_col), rules or standard_rules())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: [] for name in [*names, "base_failed", "kept"]}
            for text in texts(batch, 1):
                figures = measure(text)
                for name in names:
                    columns[name].append(getattr(figures, name))
                columns["base_failed"].append(figures.base_failed)
                columns["kept"].append(_kept(figures, ordered))
            arrays = [pa.array(columns[name], pa.int64()) for name in names]
            flags = [pa.array(columns[name], pa.bool_()) for name in ("base_failed", "kept")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays, *flags], names=[id_col, *columns]
            )

    kind = documents.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} long" for n in names)])
    return documents.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"{schema}, base_failed boolean, kept boolean"
    )


def keep_documents(
    documents: DataFrame, rules: Sequence[Rule] | None = None, *, text_col: str = "text"
) -> DataFrame:
    """The rows whose text is kept, with all their columns and types unchanged.

    Null and empty texts are rejected; an empty table stays empty.
    """
    ordered = order_rules(draw_sample(documents, text_col), rules or standard_rules())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [_kept(measure(text), ordered) for text in texts(batch, text_col)]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)
