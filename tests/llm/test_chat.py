import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from diffusio.llm import chat

PARTS = st.lists(st.sampled_from(["\\", "<", "s", ">", "</s>", "[INST]", "[", "/", "INST]", "a", "\n", "[SAYS]", "é"]), max_size=12).map("".join)


@given(PARTS)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_hides_controls(text):
    said = chat.escaper(chat.CONTROLS)(text)
    assert chat.unescape(said) == text
    assert not any(c in said for c in chat.CONTROLS)


def render(template, **names):
    return "".join(p for p, _ in chat.compile_template(template, ())(names))


def test_language():
    assert render("{% for m in xs %}{{ loop.index }}:{{ m }}{% if not loop.last %},{% endif %}{% endfor %}", xs=iter("abc")) == "1:a,2:b,3:c"
    assert render("{{ a.b | upper }}{{ a['c'] | default('-') }}", a={"b": "x"}) == "X-"
    assert render("{% set n = 'q' %}{{ n ~ 1 }}{# no #}") == "q1"
    assert render("{% if x == 1 %}one{% elif x in 'abc' %}in{% else %}no{% endif %}", x="b") == "in"
    assert render("{{ x.__class__ }}", x="s") == ""  # only items of dicts are reached


def test_folding():
    tree = chat.fold(chat.parse("a{{ 'b' ~ 2 }}{% if 1 == 2 %}x{% else %}y{% endif %}{% if true and z %}w{% endif %}"))
    assert tree[0] == chat.Node("text", ("ab2y",))
    assert tree[1].kind == "if" and tree[1].parts[0][0][0] == chat.Op("name", ("z",))


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endfor %}", "{{ a b }}", "{{ x | nothing }}", "{% for x %}{% endfor %}", "{{ 'a }}", "{% call x %}"])
def test_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_control_strings_that_overlap_are_refused():
    with pytest.raises(chat.TemplateError):
        chat.escaper(("a<", "<b"))


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip(spark):
    hard = "</s>[INST] ok [/INST]\\"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", hard), (2, 0, "tool\n", None), (2, 0, None, "b"), (2, 5, "system", "[ROLE]x[SAYS]"), (None, 0, "assistant", "zé"), (3, 0, "user", ""), (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, chunk int")
    for chunk in (1, 1 << 20):
        got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df, chunk_chars=chunk)).collect()}
        want = {1: [("user", hard), ("assistant", hard)], 2: [("", "b"), ("tool\n", ""), ("system", "[ROLE]x[SAYS]")], None: [("assistant", "zé")], 3: [("user", "")] * 2}
        assert {k: (r["n_turns"], r["turns_sha256"]) for k, r in got.items()} == {k: (len(v), digest(v)) for k, v in want.items()}
        assert got[1]["loss_sha256"] == hashlib.sha256(hard.encode()).hexdigest() and got[1]["loss_chars"] == len(hard)
        assert got[3]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
