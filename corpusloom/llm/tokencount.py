"""Token counts: pieces counted once per distinct pre-token, times per-text frequencies."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import finder
from .common import ship
from .pretokens import shuffle_words

ship(__name__)


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _parts(spec: dict | None, inner: str) -> list[dict]:
    return [] if spec is None else spec[inner] if spec["type"] == "Sequence" else [spec]


def splitter_for(path: str):
    """Text -> pre-tokens, as the file's normalizers and its splitting pattern give them.

    Understood: NFC, white space to one blank, Lowercase; Split with the pattern's
    matches kept, then ByteLevel without its own pattern.  Strings of added tokens are
    cut out of the raw text first and stand for themselves.
    """
    def make():
        import unicodedata

        import regex

        spec = _load(path)
        normal = [n["type"] for n in _parts(spec["normalizer"], "normalizers")]
        pre = _parts(spec["pre_tokenizer"], "pretokenizers")
        split = pre[0]
        if not set(normal) <= {"NFC", "Replace", "Lowercase"} or split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: a normalizer or pre-tokenizer that isn't understood here")
        find = finder(split["pattern"]["Regex"])
        specials = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        cutter = regex.compile("|".join(map(regex.escape, specials))) if specials else None

        def plain(t: str) -> list[str]:
            if not t.isascii():
                t = unicodedata.normalize("NFC", t) if "NFC" in normal else t
                t = t.replace("Σ", "σ")  # each letter by itself: no final sigma
            return find(t.lower() if "Lowercase" in normal else t)

        def run(t: str) -> list[str]:
            if cutter is None or not cutter.search(t):
                return plain(t)
            out, at = [], 0
            for m in cutter.finditer(t):
                out += [*plain(t[at : m.start()]), " " + m[0]]
                at = m.end()
            return out + plain(t[at:])

        return run

    return make


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row; NULL and empty texts count 0.

    Ids are never made for a text: the number of pieces of each distinct pre-token is
    multiplied by its frequency in the text and summed.
    """
    def worker():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = _load(tokenizer_path)
        own = Tokenizer.from_str(json.dumps(spec | {
            "normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None,
            "pre_tokenizer": _parts(spec["pre_tokenizer"], "pretokenizers")[-1],
        }))
        return lambda words: [[1 if w[0] == " " else len(e)] for w, e in zip(words, own.encode_batch(words, add_special_tokens=False))]

    kind = docs.schema[key].dataType

    def assemble(keys, sizes, ends, slots, answers, counts):
        starts, _, pieces = answers
        total = np.concatenate([[0], np.cumsum(pieces[starts[slots]].astype(np.int64) * counts)])
        tokens = np.diff(np.concatenate([[0], total[ends]]))
        return pa.RecordBatch.from_arrays(
            [keys, sizes, pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
            [key, "n_bytes", "n_tokens", "over_limit"],
        )

    return shuffle_words(
        docs, key, text, splitter_for(tokenizer_path), worker, assemble,
        f"`{key}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean", frequencies=True,
    )
