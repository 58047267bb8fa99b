"""Chat formatting: whole conversations as text, tokens with offsets, and loss masks aligned to them.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>``. The three marks are atomic tokens added to the
tokenizer, so no token crosses the border of a text. Control strings inside roles and texts are broken by
an escape pair that is undone exactly when the text is read back.

A conversation is rendered whole and encoded once. One with more than ``BLOCK_TURNS`` turns or
``BLOCK_CHARS`` characters is cut between turns into parts that are encoded one by one, so a conversation
of any size needs bounded memory and its parts spread over tasks.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that some template reads as control; none of them survives inside a text. Fixed values.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>",
           "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>"]
ESC = "␛"
BLOCK_TURNS, BLOCK_CHARS = 1024, 1_000_000
LOSS_ROLE = "assistant"
_BREAK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_UNDO = re.compile(ESC + "([01])")
_TURN_RE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
PARTS = ("conv_id long, block long, part int, text string, token_ids array<int>, token_start array<int>, "
         "token_end array<int>, loss_mask array<boolean>")


def escape(text: str) -> str:
    """Double the escape mark, then put a break after the first character of every control string."""
    return _BREAK.sub(rf"\1{ESC}1", text.replace(ESC, ESC + "0"))


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: ESC if m[1] == "0" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of the turns and the sorted character spans on which loss is taken (assistant texts)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def mask_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """True for every token that meets a span. Both lists are sorted: binary search finds the span."""
    ends = [e for _, e in spans]
    mask = []
    for start, end in offsets:
        k = bisect.bisect_right(ends, start)          # the first span that ends after the token's start
        mask.append(k < len(spans) and spans[k][0] < end)
    return mask


def masked_text(text: str, starts, ends, mask) -> str:
    """The text under the mask; tokens that share a character (parts of one code point) give it once."""
    out, done = [], 0
    for s, e, m in zip(starts, ends, mask, strict=True):
        if m:
            out.append(text[max(s, done):e])
            done = max(done, e)
    return "".join(out)


def load_tokenizer(path: str):
    """The tokenizer with the three marks as extra tokens; other special strings are ordinary text."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_tokens([AddedToken(x, normalized=False, special=False) for x in (TURN, TEXT, END)])
    t.encode_special_tokens = True
    return t


def _formatter(path: str, block_chars: int):
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load_tokenizer(path)

        def emit(key, part, turns):
            text, spans = render(turns)
            enc = tok.encode(text, add_special_tokens=False)
            return (*key, part, text, enc.ids, [s for s, _ in enc.offsets], [e for _, e in enc.offsets], mask_tokens(enc.offsets, spans))

        cols = ["conv_id", "block", "part", "text", "token_ids", "token_start", "token_end", "loss_mask"]
        frame = lambda rows: pd.DataFrame(rows, columns=cols).astype({"conv_id": "Int64"})
        key, part, turns, chars = None, 0, [], 0
        for pdf in batches:
            done = []
            for conv, block, role, text in zip(pdf["conv_id"], pdf["block"], pdf["role"], pdf["text"], strict=True):
                now = (None if pd.isna(conv) else int(conv), int(block))
                if turns and (now != key or chars + len(text) > block_chars):
                    done.append(emit(key, part, turns))
                    part, turns, chars = (part + 1 if now == key else 0), [], 0
                key = now
                turns.append((role, text))
                chars += len(text)
                if len(done) >= 64:
                    yield frame(done)
                    done = []
            yield frame(done)
        if turns:
            yield frame([emit(key, part, turns)])

    return parts


def format_conversations(conversations: DataFrame, tokenizer_path: str, block_turns: int = BLOCK_TURNS,
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``conversations`` (``conv_id, turn, role, text``) -> formatted parts with their loss mask.

    One row per part (one part per conversation unless it is very long): ``conv_id, block, part, text,
    token_ids, token_start, token_end`` (character offsets), ``loss_mask``. Parts of a conversation in the
    order of (block, part) make up its text.

    Turns are ordered by (turn, role, text), null turns first; repeated rows are separate turns. Null
    text or role is empty. Rows with a null conv_id form one conversation. An empty table gives no row.
    A single turn longer than ``block_chars`` is a part of its own. Extra columns are ignored.
    """
    rows = bounded_batches(conversations).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-2**62)).cast("long").alias("block"))
    keys = ["conv_id", "block", "turn", "role", "text"]
    return (rows.repartition("conv_id", "block").sortWithinPartitions(*keys)
            .mapInPandas(_formatter(tokenizer_path, block_chars), PARTS))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts sorted by conversation -> one row per conversation, everything read back from the output."""
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    frame = lambda rows: pd.DataFrame(rows, columns=cols).astype({"conv_id": "Int64"})
    key, state = (), None

    def close():
        n, turns, chars, loss, formatted = state
        return (key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

    for pdf in batches:
        done = []
        for conv, text, s, e, m in zip(pdf["conv_id"], pdf["text"], pdf["token_start"], pdf["token_end"], pdf["loss_mask"], strict=True):
            now = (None if pd.isna(conv) else int(conv),)
            if now != key:
                if state:
                    done.append(close())
                key, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in _TURN_RE.findall(text):
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            loss = unescape(masked_text(text, s, e, m))
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(text)
        yield frame(done)
    if state:
        yield frame([close()])


def conversation_digests(parts: DataFrame) -> DataFrame:
    """Read formatted parts back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    A conversation's parts stream through one hasher in order; none is held beyond the part at hand."""
    return (parts.select("conv_id", "block", "part", "text", "token_start", "token_end", "loss_mask")
            .repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
            .mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
