"""Line-first cleaning: rules judge each line, then documents that lose too much go.

A line fails if it is noise (symbols), navigation (separated entries),
boilerplate (a stock phrase in a short line), or if it doesn't end as a sentence
does.  Lines that fail are removed; a document is kept if enough of its words
are left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.textkit import batches_of, by_text, mixed, slices, word_hashes, word_spans

# Fixed values of the line rules, as patterns that RE2 and Python read alike.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", "<", "/", "-", "\u00bb", "\u2022", "\u00b7")
SENTENCE_END = r"""[.!?:;\x{2026}\x{3002}\x{ff01}\x{ff1f}]["')\]\x{201d}\x{2019}\x{bb}]*[ \t\r]*$"""
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|click here|sign (in|up)|log ?in|subscribe (now|to)|enable javascript|lorem ipsum|skip to content|back to top|share this|read more)"
#: A line with a stock phrase is boilerplate if it has at most so many words.
BOILERPLATE_WORDS = 15
#: Symbols beyond this share of a line's characters other than space make it noise.
SYMBOL_SHARE = 0.1
#: Separators that stand as words, beyond this share of a line's words, make it navigation.
SEPARATOR_SHARE = 0.2
#: A document is kept if its lines that pass have at least this share of its words.
KEPT_SHARE = 0.5

_SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_failed bigint, failed map<string,bigint>, n_kept_words bigint, base_failed boolean, kept boolean"


def _python(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].zfill(4), pattern))


def line_rule(line: bytes, words: list[bytes], rules: dict) -> str | None:
    """The name of the first rule that a line with words fails."""
    chars = sum(map(len, words))
    symbols = chars - len(b"".join(words).translate(None, rules["symbols"]))
    if symbols > rules["symbol_share"] * len(b"".join(words).decode("utf-8", "replace")):
        return "noise" if symbols < 2 * len(words) or b"|" not in line else "navigation"
    if sum(map(rules["separators"].__contains__, words)) > rules["separator_share"] * len(words):
        return "navigation"
    text = line.decode("utf-8", "replace")
    if len(words) <= rules["boilerplate_words"] and rules["boilerplate"].search(text):
        return "boilerplate"
    return None if rules["end"].search(text) else "punctuation"


def repeated_words(hashes: np.ndarray, numbers: np.ndarray, count: int, window: int = 3) -> np.ndarray:
    """For each text, the words in windows of consecutive words that it has twice or more."""
    out = np.zeros(count, dtype=np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        return out
    keys = mixed(numbers[:n].astype(np.uint64))
    for at in range(window):
        keys = mixed(keys + hashes[at : at + n])
    whole = np.flatnonzero(numbers[:n] == numbers[window - 1 :])
    order = whole[np.argsort(keys[whole], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    for at in range(1, window):
        covered[at:] |= twice[:-at]
    return np.bincount(numbers[covered], minlength=count)


def _judge(names: list[str], rules: dict, kept_share: float, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, boilerplate = _python(rules["end"]), _python(rules["boilerplate"])
        own = rules | {"end": end, "boilerplate": boilerplate}
        symbol = np.zeros(256, dtype=np.int64)
        symbol[list(rules["symbols"])] = 1
        character = (np.arange(256) & 0xC0) != 0x80
        for rows, data, offsets in slices(batches):
            count = rows.num_rows
            starts, ends, numbers = word_spans(data, offsets)
            n_words = np.bincount(numbers, minlength=count)
            in_word = character[data]
            in_word[(data == 0x20) | ((data >= 9) & (data <= 13))] = False
            chars = np.concatenate(([0], np.cumsum(in_word)))
            symbols = np.concatenate(([0], np.cumsum(symbol[data])))
            repeats = repeated_words(word_hashes(data, starts, ends), numbers, count)
            raw, out = data.tobytes(), []
            for i in range(count):
                lines = raw[offsets[i] : offsets[i + 1]].split(b"\n")
                seen, failed, kept, kept_words, duplicates, with_words = set(), Counter(), [], 0, 0, 0
                for line in lines:
                    words = line.split()
                    if not words:
                        continue
                    with_words += 1
                    duplicates += line in seen
                    seen.add(line)
                    rule = line_rule(line, words, own)
                    if rule:
                        failed[rule] += 1
                    else:
                        kept.append(line)
                        kept_words += len(words)
                base = bool(n_words[i] < 50 or 100 * repeats[i] > 50 * n_words[i])
                row = (int(n_words[i]), int(chars[offsets[i + 1]] - chars[offsets[i]]), int(symbols[offsets[i + 1]] - symbols[offsets[i]]), duplicates, int(repeats[i]), with_words, sum(failed.values()), list(failed.items()), kept_words, base, bool(not base and kept_words >= kept_share * n_words[i]))
                out.append((*row, b"\n".join(kept).decode()) if with_text else row)
            kinds = [pa.int64()] * 7 + [pa.map_(pa.string(), pa.int64()), pa.int64(), pa.bool_(), pa.bool_()] + [pa.string()] * with_text
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            kept_columns = [rows.column(rows.schema.get_field_index("_key"))]
            yield pa.RecordBatch.from_arrays([*kept_columns, *columns], names=names)

    return run


def quality_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text", kept_share: float = KEPT_SHARE, symbol_share: float = SYMBOL_SHARE, separator_share: float = SEPARATOR_SHARE, boilerplate: str = BOILERPLATE, boilerplate_words: int = BOILERPLATE_WORDS, with_text: bool = True) -> DataFrame:
    """One row for each document: figures of the whole text, lines failed by rule, the verdict and the clean text.

    Columns: the key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_failed, failed (rule: lines), n_kept_words,
    base_failed, kept and clean_text (if with_text).  A null or empty text has
    no words, so base_failed; repeated rows get a row each; an empty table gives
    none; other columns are not read.  Lines without a word are neither judged
    nor kept.
    """
    kind = dict(docs.dtypes)[key]
    rules = {"symbols": SYMBOLS.encode(), "symbol_share": symbol_share, "separators": frozenset(x.encode() for x in SEPARATORS), "separator_share": separator_share, "boilerplate": boilerplate, "boilerplate_words": boilerplate_words, "end": SENTENCE_END}
    schema = f"`{key}` {kind}, {_SCHEMA}" + ", clean_text string" * with_text
    names = [part.strip().split(" ")[0].strip("`") for part in re.sub(r"<[^>]*>", "", schema).split(",")]
    return batches_of(docs.select(docs[key].alias("_key"), docs[text].alias("text")), _judge(names, rules, kept_share, with_text), schema)
