import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat, queries
from tessella.llm.templates import Const, If, Output, Text, TemplateError, compile_template, fold, parse

PIECES = [*chat.CONTROLS, "\\", "[", "<", "/", "a", "\n", "é", "INST]", "s>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[INST]\\"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_round_trip(given_turns):
    render = compile_template(chat.TURN, chat.escape)
    parts = [render({"turn": {"role": r, "text": t}}) for r, t in given_turns]
    assert list(chat.turns("".join(p[0] for p in parts))) == given_turns
    learnt = [chat.unescape(p[0][a:b]) for p in parts for a, b in p[1]]
    assert "".join(learnt) == "".join(t for r, t in given_turns if r == "assistant")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_no_control_string_is_left(text):
    escaped = chat.escape(text)
    assert not any(c in escaped for c in chat.CONTROLS) and chat.unescape(escaped) == text


def brute(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        c: (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            sum(len(t) for r, t in turns if r == "assistant"),
            hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest(),
        )
        for c, turns in out.items()
    }


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "[/INST]</s>"), (1, 1, "assistant", "tie"), (1, None, "system", None), (2, 0, "tool", "x"), (2, 0, "tool", "x"), (3, 5, None, None), (None, 0, "user", "who"), (None, 1, "assistant", "")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k} \\ <s>" * 9) for k in range(400)]
    return spark.createDataFrame([(*r, "z", True) for r in rows], "conv_id long, turn long, role string, text string, part string, more boolean"), rows


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_awkward_rows(talks, size):
    df, rows = talks
    parts = chat.format_conversations(df, part_chars=size)
    assert (parts.where("part > 0").count() > 10) == (size == 500)
    assert got(chat.read_back(parts)) == brute(rows)
    assert chat.digest(df.where("false")).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "</s>[INST] ok [/INST]"
    assert got(queries.QUERIES["op7_chat_format"](spark, sf_dir)) == brute([*rows, (-1, 0, "user", own), (-1, 1, "assistant", own)])


def test_language():
    render = compile_template("{% for m in ms %}{{ loop.index0 }}{% if m.r == 'a' and not loop.last %}{% generation %}{{ m['t'] | upper }}{% endgeneration %}{% elif m.t in 'xyz' %}?{% else %}!{% endif %}{{- ' ' ~ 1 + 2 }}{% endfor %}{# gone #}")
    assert render({"ms": [{"r": "a", "t": "é"}, {"r": "b", "t": "x"}, {"r": "a", "t": "q"}]}) == ("0É 31? 32! 3", [(1, 2)])
    assert compile_template("{{ none }}{{ x.y.z }}{{ x | default('d') }}{% set x = 2 %}{{ x * 3 % 4 }}")({}) == ("d2", [])


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ 1 + 2 }}{% if 1 < 2 and true %}c{% else %}{{ x }}{% endif %}d")) == (Text("ab3cd"),)
    assert fold(parse("{% for x in none %}never{% endfor %}{% if x or false %}y{% endif %}"))[0] == If(fold(parse("{{ x or false }}"))[0].value, (Text("y"),), ())
    assert fold(parse("{{ 'a' | upper | length }}")) == (Text("1"),)
    assert isinstance(fold(parse("{{ x + 1 }}"))[0], Output) and Const(1) in fold(parse("{{ x + 1 }}"))[0].value.args


@pytest.mark.parametrize("source", ["{{ x", "{% for x %}{% endfor %}", "{% if x %}", "{{ x() }}", "{{ x | eval }}", "{{ import os }}", "{% include 'a' %}", "{{ 'a }}", "{% endif %}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_sandbox():
    out, _ = compile_template("{{ x.__class__ }}{{ x['__class__'] }}{{ ''.__class__.__mro__ }}{{ loop }}")({"x": object()})
    assert out == ""
    with pytest.raises(TemplateError):
        compile_template("{{ 'a' * 10 }}")({})
