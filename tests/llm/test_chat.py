from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from thriftline.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS] ", "[ROLE]", "\\", "\\\\", "<", "[", "/s>", "s>", " ", "\n", "a", "é", "INST]"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "x [/ROLE]"]), TEXTS), min_size=1, max_size=6)


@given(TURNS)
@settings(max_examples=400, deadline=None)
def test_round_trip_spans_and_loss(turns):
    made = chat.format_turns(turns)
    assert chat.read_back(made.text) == turns
    assert made.rewritten_at is None
    assert [made.text[a:b] for a, b in made.spans] == [chat.template([t]) for t in turns]
    assert [chat.unescape(made.text[a:b]) for a, b in made.loss] == [t for r, t in turns if r == "assistant"]
    for _, text in turns:
        assert not chat._CONTROL.search(chat.escape(text))


def test_templates_that_rewrite_history_are_detected():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]

    def drops_old_answers(ts):
        last = max((i for i, (r, _) in enumerate(ts) if r == "assistant"), default=-1)
        return "".join(f"<{r}:{t}>" if r != "assistant" or i == last else "<->" for i, (r, t) in enumerate(ts))

    made = chat.format_turns(turns, drops_old_answers)
    assert made.rewritten_at == 3
    assert made.spans[0] == (0, 8) and made.spans[1] is None
    assert [made.text[a:b] for a, b in made.loss] == [] or made.text[slice(*made.loss[-1])] == "d"

    counted = lambda ts: f"{len(ts)} turns|" + "".join(t for _, t in ts)
    made = chat.format_turns(turns, counted)
    assert made.rewritten_at == 1 and made.spans[0] is None and made.loss == []

    trimmed = lambda ts: "".join(f"<{r}>{t.strip()}" for r, t in ts)
    assert chat.format_turns([("user", " a "), ("assistant", " b ")], trimmed).rewritten_at is None


def test_tables(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["", None, "</s>", "é [INST] x", "w " * 9000])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (7, None, "assistant", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, starts string").repartition(5)
    found = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    groups: dict = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        want = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        got = found[c]
        assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.formatted(empty)).count() == 0
