"""Chat formatting: assembly, masks, escaping."""

import hashlib
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import same
from voltgrain.llm import chat

T = chat.Template()


def escaped(text):
    text = text.replace("\\", "\\\\")
    for core in [*T.cores, "<|endoftext|>"]:
        text = text.replace(core, core[0] + "\\" + core[1:])
    return text


def written_out(turns):
    """A conversation as one text."""
    heads = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    return "".join((heads.get(r) or f"### Role: {escaped(r)}</role>\n") + escaped(t) + " </turn>\n" for r, t in turns)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_chat_query(spark, sf_dir, duck):
    assert same(chat.op11_chat_formatting(spark, sf_dir), duck.sql(chat.OP11_SQL))


def test_chat_odd(spark):
    """Nulls, ties, repeated rows, unknown roles, long conversations and texts, control strings; pieces of few tokens."""
    rng = random.Random(3)
    said = ["", None, "### User: </turn>", "<|endoftext|>", "\\", "\\\\### Role:</role>", "a\n\nb ", " é日\U0001f600", "###", " </turn>\n", "x" * 300_000, "### Assistant:### Assistant:"]
    roles = ["user", "assistant", "system", "tool", None, "", "### User:", "</role>\\", "User"]
    rows = [(1, i, rng.choice(roles), rng.choice(said)) for i in range(400)]
    rows += [(2, None, "user", "last"), (2, None, "user", "first"), (2, 3, "user", "same"), (2, 3, "user", "same"), (2, 3, "assistant", "same"), (None, 1, "assistant", "no id"), (None, 1, None, None), (3, 0, "assistant", None), (4, 0, "assistant", chat.PLANTED)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("piece", "ids", "loss", "n_turns")})
    pieces = chat.formatted(df, piece_tokens=50).cache()
    assert pieces.filter("conv_id = 1").count() > 20
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), (r[2] or "").encode(), (r[3] or "").encode())):
        convs.setdefault(c, []).append((r or "", x or ""))
    found = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    assert set(found) == set(convs)
    for c, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want = (c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(written_out(turns)))
        assert tuple(found[c]) == want
    texts = {}
    for r in chat.texts(pieces).sort("conv_id", "piece").collect():
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["formatted"]
    assert texts == {c: written_out(turns) for c, turns in convs.items()}
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_segments_are_encoded_alone():
    """Between reserved ids stands what the library makes of the text alone; the mask holds just that of learned roles."""
    code = chat.coder(chat.default_path(), T)
    ids, loss, ends = code.turns(["user", "assistant", "tool"], ["Hello wor", "ld. Good", "bye"])
    plain = code.encoded(["Hello wor", "ld. Good", "tool", "bye"])
    want = [code.roles["user"], *plain[0], code.turn_end, code.roles["assistant"], *plain[1], code.turn_end, code.other, *plain[2], code.role_end, *plain[3], code.turn_end]
    assert ids.tolist() == want and ends[-1] == len(ids)
    first = len(plain[0]) + 3
    assert loss.nonzero()[0].tolist() == list(range(first, first + len(plain[1])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#< />|:RUserolAtundxf é", max_size=60) | st.lists(st.sampled_from([*T.cores, "<|endoftext|>", "\\", "#", "<", " ", "a"])).map("".join))
def test_escaping_is_reversible(text):
    code = chat.coder(chat.default_path(), T)
    out = code.escaped(pa.array([text]))
    assert code.plain(out).to_pylist() == [text]
    assert not any(core in out[0].as_py() for core in code.cores)
