import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import chat
from verdigris.llm.templates import Const, Show, Template, TemplateError, Text, escape, messages_of, unescape


@pytest.mark.parametrize(
    ("source", "values", "expected"),
    [
        ("a{{ x }}b", {"x": 3}, "a3b"),
        ("{{ x.y['z'] }}", {"x": {"y": {"z": "deep"}}}, "deep"),
        ("{% for m in ms %}{{ loop.index }}{{ m }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": ["a", "b"]}, "1a,2b"),
        ("{% if a == 1 and b %}x{% elif a > 2 or not b %}y{% else %}z{% endif %}", {"a": 3, "b": True}, "y"),
        ("{% set n = 2 * 3 - 1 %}{{ n // 2 }}{{ n % 3 }}{{ -n }}", {}, "22-5"),
        ("{{ 'x' ~ 1 + 1 }}|{{ ('a' in 'cab') and 'yes' }}|{{ 'k' not in d }}", {"d": {"k": 1}}, None),
        ("{{ 'yes' if 'a' in 'cab' else 'no' }}{{ 'k' not in d }}", {"d": {"k": 1}}, "yesFalse"),
        (" {{- x -}} ", {"x": "t"}, "t"),
        ("{# gone #}{{ ' q '|trim|upper|length }}", {}, "1"),
        ("{{ x.__class__ }}{{ x.missing.more }}{{ y[9] }}", {"x": {}, "y": [1]}, ""),
        ("{{ 'it''s' }}", {}, None),
        ("{{ 'a\\'b\\n' }}", {}, "a'b\n"),
    ],
)
def test_expressions(source, values, expected):
    if expected is None:
        with pytest.raises(TemplateError):
            Template(source).render(**values)
    else:
        assert Template(source).render(**values)[0] == expected


@pytest.mark.parametrize("source", ["{{ f(1) }}", "{{ x", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{% import os %}", "{{ x|attr }}", "{{ 9999999999 * 9999999999 * 9 }}", "{{ 'a' * 9 }}", "{{ 1 // 0 }}", "{{ }}"])
def test_sandbox_and_errors(source):
    out = None
    try:
        out = Template(source).render()[0]
    except TemplateError:
        return
    assert out == source  # a tag that is not closed is text


def test_constants_are_folded():
    assert Template("a{{ 'b' ~ 2 * 3 }}{% if 1 < 2 %}c{% else %}{{ x }}{% endif %}d").tree == (Text("ab6cd"),)
    (show,) = Template("{{ x if true and true else y }}").tree
    assert isinstance(show, Show) and not isinstance(show.what, Const)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn x>", "", "a\nb", "\\"]), st.lists(st.sampled_from(["\\", "<", ">", "l", "g", "</turn>\n", "<turn assistant>\n", "\n", "é", "x"])).map("".join)), max_size=6), st.integers(1, 40))
def test_round_trip(rows, size):
    reader = chat.Reader()
    whole = ""
    for formatted, learned in chat.chunks(Template(chat.TURNS), iter(rows), size=size):
        reader.read(formatted, learned)
        whole += formatted
    assert reader.turns == len(rows) and reader.chars == len(whole)
    assert reader.said.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
    loss = "".join(t for r, t in rows if r == "assistant")
    assert (reader.loss_chars, reader.loss.hexdigest()) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted, spans = Template(chat.TURNS).render(messages=[{"role": r, "text": t} for r, t in rows])
    assert formatted == whole and unescape("".join(formatted[a:b] for a, b in spans)) == loss
    assert all(unescape(escape(t)) == t for _, t in rows)


def test_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (2, 5, "user", "x"), (2, 5, "user", "x"), (None, 0, "assistant", "lone"), (3, 0, "assistant", "y" * 2_000_000), (3, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'clash' as chunk", "1 as n_turns").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 3, None: 1, 3: 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\nuser\nx\nuser\nx\n").hexdigest()
    assert got[None].loss_chars == 4 and got[3].loss_chars == 2_000_000
    parts = sorted((r.chunk, r.formatted) for r in chat.render(df).collect() if r.conv_id == 3)
    assert len(parts) == 2 and parts[1][1] == "<turn user>\nz\n</turn>\n"
    assert chat.render(df.where("conv_id = 1"), add_generation_prompt=True).first().formatted.endswith("</turn>\n<turn assistant>\n")
    assert chat.read_back(df.limit(0)).count() == 0


def test_a_stream_is_looped_over_once_or_refused():
    rows = [("user", "a"), ("assistant", "b")]
    loop = "{% for m in messages %}{{ m.text }}{% endfor %}"
    assert Template(loop).render(messages=messages_of(rows))[0] == "ab"
    for bad in (loop + loop, "{{ messages|length }}", "{{ messages[0].text }}", "{% if messages %}x{% endif %}", "{{ 'a' in messages }}", "{{ messages ~ '' }}", "{{ messages == none }}"):
        with pytest.raises(TemplateError):
            Template(bad).render(messages=messages_of(rows))
    assert Template(loop + loop + "{{ messages|length }}").render(messages=[*iter(messages_of(rows))])[0] == "abab2"


def test_texts_can_not_fill_memory():
    with pytest.raises(TemplateError):
        Template("{% set x = 'ab' ~ y %}" + "{% set x = x ~ x %}" * 40).render(y="c")
