"""Forms of assignment in source and configuration, each with a harmless twin."""

import time

import pytest

from prosemill.llm import secrets

S = "Zx9Qk2Lm8Pq1"


def literals(text):
    return {text[a:b] for a, b in secrets.scan(text)["literal"]}


@pytest.mark.parametrize(("text", "twin"), [
    ('auth_key: str = "{}"', 'colour: str = "{}"'), ('const apiSecret: string = "{}";', 'const apiUrl: string = "{}";'), ('auth_key: Optional[str] = "{}"', 'shape: Optional[str] = "{}"'),
    ('auth_key = ("{}")', 'colour = ("{}")'), ('auth_key = (\n    "{}"\n)', 'colour = (\n    "{}"\n)'), ('auth_key += "{}"', 'colour += "{}"'), ('auth_key = """{}"""', 'colour = """{}"""'),
    ("auth_key = '''{}'''", "colour = '''{}'''"), ('#define AUTH_KEY "{}"', '#define COLOUR "{}"'), ('<add key="ApiSecret" value="{}"/>', '<add key="Colour" value="{}"/>'),
    ('<add value="{}" key="ApiSecret"/>', '<add value="{}" key="ApiSecretUrl"/>'), ("<property name='db.auth.key' value='{}'>", "<property name='db.colour' value='{}'>"),
    ('{{"db_auth": {{"key": "{}"}}}}', '{{"db_colour": {{"key": "{}"}}}}'), ("auth:\n  host: here\n  key: {}\nnext: x", "colour:\n  host: here\n  key: {}\nnext: x"), ("AUTH_KEY ?= {}", "COLOUR ?= {}"),
    ("AUTH_KEY ::= {}", "COLOUR ::= {}"), ("<auth_key>{}</auth_key>", "<colour>{}</colour>"), ("<auth_key>\n  {}</auth_key>", "<auth_key>{}</other>"), ("'auth' => ['key' => '{}']", "'colour' => ['key' => '{}']"),
    ("def f(auth_key: str = '{}', n: int = 3): pass", "def f(colour: str = '{}', n: int = 3): pass"), ("auth:\n  key: {}", "auth:\nkey: {}"),
])
def test_forms(text, twin):
    assert literals(text.format(S)) == {S}
    assert literals(twin.format(S)) == set()


def test_literals_side_by_side():
    text = 'auth_key = "Zx9Qk2" "Lm8Pq1"\nother = "Zx9Qk2" "Lm8Pq1"'
    assert [text[a:b] for a, b in secrets.scan(text)["literal"]] == ["Zx9Qk2", "Lm8Pq1"]
    text = 'auth_key = ("Zx9Qk2"\n  "Lm8Pq1")\ncolour = 1'
    assert literals(text) == {"Zx9Qk2", "Lm8Pq1"}


def test_prose_and_code_without_secrets():
    for text in (
        "auth: the key word is here\n  and more words: nothing", 'auth_key: str = ""', "auth_key: str = os.environ[name]", "<auth_key></auth_key>", "Dear reader: (the token) is not here", '#define AUTH_KEY', "auth:\n  - key",
        "key: value", '{"auth": {"type": "Zx9Qk2Lm8Pq1"}}', "<input name='q' value='several words here'>", "x = (1 + 2)\nthe key", '"""a doc string about the auth_key: nothing"""',
    ):
        assert literals(text) == set(), text


def test_floods_stay_linear():
    began = time.time()
    for flood in ("auth:\n " * 100000, "({[" * 200000, '"""' * 200000 + '"', "a: b[" * 100000, "<a " * 200000, "<add key='a' value='b'" * 50000, "#define A " * 100000, "<a>b" * 100000, "\n" + "  " * 500000):
        secrets.scan(flood)
    assert time.time() - began < 30
