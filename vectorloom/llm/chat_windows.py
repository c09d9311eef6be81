"""Chat formatting in budgeted windows.

A conversation is rendered turn by turn and its tokens are counted through.
Windows of whole turns are chosen on those prefix sums: each keeps the system
turns, repeats a limited history, and goes on as far as the budget allows.
Targets are the assistant's turns; one that an earlier window has taught is masked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, bpe

BUDGET, HISTORY, TARGET, SYSTEM = 2048, 512, "assistant", "system"


def rendered(role: str | None, text: str | None) -> tuple[str, str, str]:
    """Head, body and end of a turn; only body and end are targets."""
    return f"<|{role or 'unknown'}|>\n", text or "", "<|end|>\n"


def spans(lengths: np.ndarray, fixed: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first turn, first new turn, end) of each window over turns of these
    lengths, when `fixed` tokens are in every window. History is the longest
    run of turns before the new ones within `history` tokens that leaves room for
    the first new turn. A turn that alone exceeds the budget is a window of its own, whole."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    out, at, n = [], 0, len(lengths)
    while at < n:
        room = min(history, budget - fixed - (sums[at + 1] - sums[at]))
        first = at if room < 0 else int(np.searchsorted(sums, sums[at] - room, "left"))
        end = max(at + 1, int(np.searchsorted(sums, sums[first] + budget - fixed, "right")) - 1)
        out.append((first, at, end))
        at = end
    return out


_OUT = "conv_id long, window int, first_turn long, first_new_turn long, last_turn long, n_tokens int, over_budget boolean, input_ids array<int>, target_spans array<struct<start:int,end:int>>"


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, target: str = TARGET, system: str = SYSTEM, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of every conversation: conv_id, window, first_turn,
    first_new_turn and last_turn (numbers of turns as given), n_tokens, over_budget, input_ids
    and target_spans (ranges of input_ids that are learned; all else is masked).

    Turns are in the order of turn, role and text; turns equal in all three count once. A null
    turn comes first and is shown as null; a null role is "unknown"; a null text
    is empty. Rows with a null conv_id take no part. System turns, wherever they stand, open
    every window and are never targets. A conversation of system turns alone gives one
    window (turn numbers of the system turns). A turn longer than the budget is kept whole in a window with over_budget. Other columns
    are ignored; an empty table gives no rows.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    talks = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_set(turn)).alias("turns"))

    def run(batches):
        coder = bpe(tokenizer)
        known: dict[str, np.ndarray] = {}

        def ids(text):
            if len(text) > 40:
                return coder.ids(text)
            if text not in known:
                known[text] = coder.ids(text)
            return known[text]

        for batch in batches:
            rows = []
            for conv, talk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = []
                for t in talk:
                    head, body, end = (ids(p) for p in rendered(t["role"], t["text"]))
                    coded.append((t["turn"], t["role"], len(head), np.concatenate([head, body, end])))
                fixed = [c for c in coded if c[1] == system]
                rest = [c for c in coded if c[1] != system]
                lead = [c[3] for c in fixed]
                start = sum(map(len, lead))
                cuts = spans(np.array([len(c[3]) for c in rest], np.int64), start, budget, history) if rest else [(0, 0, 0)]
                for w, (first, new, end) in enumerate(cuts):
                    part, at, learned = rest[first:end], start, []
                    for k, (_, role, head, tokens) in enumerate(part):
                        if role == target and first + k >= new:
                            learned.append({"start": at + head, "end": at + len(tokens)})
                        at += len(tokens)
                    shown = part or fixed
                    rows.append((conv, w, shown[0][0], rest[new][0] if part else shown[0][0], shown[-1][0], at, at > budget, np.concatenate(lead + [c[3] for c in part]).astype(np.int32), learned))
            cols = list(zip(*rows)) if rows else [[]] * 9
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return talks.mapInArrow(run, _OUT)
