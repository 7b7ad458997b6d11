"""Token ids of public tokenizer files inside Python workers.

``load(path)`` gives ``each(texts)``, which yields the ids of one text after another, with the library's default handling of
special strings inside texts and without added special tokens.  A byte-level BPE ``.json`` whose merge
ranks follow its ids is run by ``tiktoken`` on the same ranks and special tokens: the ids are the same
and it takes about a fifth of the time; every other ``.json`` is run by ``tokenizers`` itself, and so is any
text that the fast path refuses (its split pattern runs out of stack in a blank run of about a million).
"""

from __future__ import annotations

import functools
import hashlib
import json

# The split pattern of byte-level BPE, and the printable bytes that stand for themselves.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = ((33, 126), (161, 172), (174, 255))


def _byte_of_char() -> dict[str, int]:
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, or None if this file isn't plain byte-level BPE with ranks in id order."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("truncation") or spec.get("padding"):
        return None
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t.get("special") for t in spec.get("added_tokens", [])):
        return None
    byte_of = _byte_of_char()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [bytes(byte_of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    except KeyError:
        return None
    ids = [ranks.get(m, -1) for m in merged]
    if len(set(merged)) != len(merged) or ids != sorted(ids) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(merged):
        return None
    return ranks


class Encoder:
    """``each(texts)`` yields the ids of one text after another."""

    def __init__(self, path: str):
        self.digest, self.path, self._library = file_digest(path), path, None
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.one = piece.encode
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        if ranks is None:
            self.one = self.by_library
            return
        import tiktoken

        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.fast = tiktoken.Encoding(self.digest, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.one = self._fast_or_library

    def _fast_or_library(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:  # the regex engine's stack has a bound, the library's has none
            return self.by_library(text)

    def by_library(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids

    def each(self, texts):
        return map(self.one, texts)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
