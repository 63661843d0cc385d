import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosemill.operators.mask import HOLE, solid_text


def shown(text):
    return solid_text(text).replace(HOLE, " ")


HIDDEN = [
    ("Tide table:\n\n```python\nheight = gauge.read()\n```\n", "height = gauge.read()"),
    ("~~~~\nlow water at six\n~~~~", "low water at six"),
    ("Turn the `mooring_line` twice.", "`mooring_line`"),
    ("---\nharbour: north quay\nberths: 40\n---\nThe quay is long.", "harbour: north quay\nberths: 40"),
    ("---\nharbour: south\n...\nThe quay is short.", "harbour: south"),
    ("Depth $d = h + t$ changes hourly.", "$d = h + t$"),
    ("$$\nd = h + t\n$$\nis the depth", "d = h + t"),
    ("Charts at www.charts.example/north?x=1 are free.", "www.charts.example/north?x=1"),
    ("Ask [[Pilots#Rota|whoever is on]] first.", "[[Pilots#Rota|whoever is on]]"),
    ("Ask ![[rota.png]] first.", "![[rota.png]]"),
    ("See [the rota](rota.md \"June\") today.", "](rota.md \"June\")"),
    ("![a lighthouse](light.jpg) stands there", "a lighthouse"),
    ("### Night entry\nKeep left.", "### Night entry"),
    ("Lights\n------\nRed is port.", "------"),
    ("| buoy | colour |\nwords", "| buoy | colour |"),
    ("12) cast off", "12) "),
    ("> * [x] check the bilge", "> * [x] "),
    ("~~never~~ always", "~~"),
    ("Logged under #voyage/day-2 as usual.", "#voyage/day-2"),
    ("Fuel is low[^fuel] again", "[^fuel]"),
    ("The last line has an anchor ^line-9\nnext", "^line-9"),
    ("a <span title='x'>small</span> boat", "<span title='x'>"),
    ("before <!-- ask\nthe pilot --> after", "ask\nthe pilot"),
    ("\tsteer 090\n", "steer 090"),
    ("Type ```` ``` ```` to fence", "``` "),
    (">> ~~~\n>> quoted log\n>> ~~~\n", "quoted log"),
    ("`````\nouter\n````\ninner fence stays open\n`````\n", "inner fence stays open"),
]
KEPT = [
    ("Turn the `mooring_line` twice.", "twice"),
    ("---\nharbour: north\n---\nThe quay is long.", "The quay is long."),
    ("Morning.\n\n***\n\nEvening.", "Evening."),
    ("See [the rota](rota.md) today.", "the rota"),
    ("12) cast off", "cast off"),
    ("> the log says so", "the log says so"),
    ("~~never~~ always", "never"),
    ("the log_book_two name", "log_book_two"),
    ("Berth #7 is free", "#7"),
    ("Fees rose from $8 to $12 this year.", "to"),
    ("---\nno end: of this\nthe quay", "the quay"),
    ("A lone ` here.\n\nThis line is prose.\n\nThen `tide` again.", "This line is prose."),
    ("~~~\n> ~~~\n> inside\n~~~\n\nOutside again.", "Outside again."),
    ("> ~~~\n> open fence\n\nThe quote has ended.", "The quote has ended."),
    ("- rope\n    - short rope", "short rope"),
]


@pytest.mark.parametrize(("text", "needle"), HIDDEN)
def test_hidden(text, needle):
    at = text.index(needle)
    assert shown(text)[at : at + len(needle)].strip() == ""


@pytest.mark.parametrize(("text", "needle"), KEPT)
def test_kept(text, needle):
    at = text.index(needle)
    assert shown(text)[at : at + len(needle)] == needle


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab #>-*_`~$<>[]()!|:/.\n\t12é🎯\r=^\"")), max_size=60))
def test_same_length_and_only_blanked(text):
    out = shown(text)
    assert len(out) == len(text)
    assert all(a == b or b == " " for a, b in zip(text, out))
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(out) if c == "\n"]


def test_degenerate():
    assert solid_text(None) == "" and solid_text("") == ""


@pytest.mark.parametrize("text", ["`" * 50000, "` x " * 20000, "$" * 20000, "[" * 20000, "<" * 20000, " " * 40000 + "x", "\t" * 40000 + "x", "*_" * 20000, "$a " * 5000])
def test_floods_stay_fast(text):
    began = time.time()
    solid_text(text)
    assert time.time() - began < 4
