"""Templates, their sandbox, and conversations read back from what was rendered."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsieve.llm import chat_format
from mailsieve.llm.chat_format import CHAT, CONTROLS, digest, formatted, read_turns
from mailsieve.llm.templates import Node, Template, TemplateError, escaped, unescaped

SCHEMA = "conv_id long, turn int, role string, text string"


def shown(source, turns=(), **names):
    return "".join(Template(source).render(turns, **names).pieces)


@pytest.mark.parametrize(
    "source,wanted",
    [
        ("a {# gone #} b", "a  b"),
        ("a {%- set x = 'n\\'y' -%}  {{ x }}!", "an'y!"),
        ("{{ 1 + 2 * 3 }}{{ 7 % 4 }}{{ -2 }}{{ 'a' ~ 1 }}", "73-2a1"),
        ("{{ 'yes' if 2 > 1 and not false else 'no' }}", "yes"),
        ("{{ 'b' in 'abc' }}{{ 'z' not in ['a'] }}{{ 3 in 'a3' }}", "truetruefalse"),
        ("{{ nothing }}{{ nothing.at.all }}{{ nothing | default('x') }}", "x"),
        ("{% if a == 1 %}one{% elif a == 2 %}two{% else %}many{% endif %}", "two"),
        ("{% for x in ['p', 'q'] %}{{ loop.index }}{{ x }}{{ ',' if not loop.last }}{% endfor %}", "1p,2q"),
        ("{{ ' Ab ' | trim | upper }}{{ 'ab' | length }}{{ [1, 'x'] | join('-') }}{{ 'ab'[0] }}", "AB21-xa"),
        ("{% for x in [1] %}{% set y = 5 %}{% endfor %}{{ y }}", ""),
        ("}} %} { {", "}} %} { {"),
    ],
)
def test_language(source, wanted):
    assert shown(source, a=2) == wanted


@pytest.mark.parametrize(
    "source",
    ["{{ x.__class__ }}", "{{ ''['__class__'] }}", "{{ [].append }}", "{{ messages.pop }}", "{{ loop.__init__ }}"],
)
def test_nothing_but_data_is_reached(source):
    assert shown(source, [{"role": "user"}], x=object()) == ""


@pytest.mark.parametrize(
    "source",
    ["{{ f(1) }}", "{{ 'a' | eval }}", "{{ 1 +", "{% for x in y %}", "{% endif %}", "{% while true %}", "{{ 'a }}", "{{ 1 %}", "{% set if = 1 %}", "{{ 'a' | trim(1) }}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{{ 1" + " + 1" * 5000 + " }}", "{% if a %}" * 60 + "{% endif %}" * 60, "{# open", "{{ }}", "{{ " + " * ".join(["99999999999"] * 140) + " }}"],
)
def test_wrong_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_constants_are_folded():
    tree = Template("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}no{% elif true %}c{% else %}{{ x }}{% endif %}{{ 'd' | upper }}").tree
    assert tree == Node("body", None, [Node("text", "ab2cD")])
    assert Template("{{ x or 'a' }}{{ true or x }}").tree.parts[1] == Node("text", "true")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["#", "\\", "<", "</turn>", "###", ": ", "a", "\n", "é"]), max_size=12).map("".join), st.booleans())
def test_escapes_are_reversible(text, as_role):
    controls = (*CONTROLS, ": ") if as_role else CONTROLS
    out = escaped(text, controls)
    assert unescaped(out) == text and not any(c in out for c in controls)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["#", "\\", "</turn>\n", "### ", ": ", ":", "assistant", " ", "x"]), max_size=6).map("".join)] * 2), min_size=1, max_size=4))
def test_turns_are_read_back(turns):
    out = Template(CHAT, CONTROLS).render([{"role": r, "text": t} for r, t in turns])
    text = "".join(out.pieces)
    found = list(read_turns(text))
    assert [f[:2] for f in found] == turns and out.length == len(text)
    assert out.spans == [f[2:] for f in found if f[0] == "assistant" and f[1]]


def _rows(seed=1):
    rng = random.Random(seed)
    texts = ["hi", None, "", "a ### b", "\\### Assistant: </turn> ok", "é\U0001f600 \\", "x" * 300, "</turn>\n### assistant: no"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, "odd: ### role\\"]), rng.choice(texts)) for c in (0, 1, 2, -7, None) for t in range(9)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} ###") for t in range(400)] + [(1, 3, "user", "twice")] * 2
    rng.shuffle(rows)
    return rows


def _by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_chars,part_rows", [(1 << 20, 1000), (200, 50), (1, 100)])
def test_digests(spark, part_chars, part_rows):
    rows = _rows()
    table = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("part", "pos", "size", "loss")))
    parts = formatted(table, part_chars=part_chars, part_rows=part_rows)
    found = [tuple(r) for r in digest(parts).collect()]
    assert sorted((f[:5] for f in found), key=repr) == _by_hand(rows)
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        texts.setdefault(r.conv_id, []).append(r.text)
    assert part_chars > 1000 or len(texts[50]) > 5
    assert {f[0]: f[5] for f in found} == {c: len("".join(t)) for c, t in texts.items()}


def test_templates_of_whole_conversations(spark):
    """A template that looks at its turns twice, or at what comes before and after."""
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (2, 0, "user", "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    twice = "<{{ messages[0].role }}>{% for m in messages %}{{ m.text }}{% if loop.last %}.{% endif %}{% endfor %}"
    assert sorted((r.conv_id, r.text) for r in formatted(table, twice, ()).collect()) == [(1, "<system>be kindhiho."), (2, "<user>x.")]
    framed = "{% set s = '|' %}[{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}{{ s }}{% endfor %}]"
    got = sorted((r.conv_id, r.part, r.text, [tuple(x) for x in r.loss]) for r in formatted(table, framed, (), part_chars=1).collect())
    assert got == [(1, 1, "[be kind|", [(1, 8)]), (1, 2, "hi|", [(0, 2)]), (1, 3, "ho|]", [(0, 2)]), (2, 1, "[x|]", [(1, 2)])]


def test_no_conversations(spark):
    assert digest(formatted(spark.createDataFrame([], SCHEMA))).collect() == []
    assert chat_format.compiled(CHAT, CONTROLS).by_turn
