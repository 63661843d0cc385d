"""Literals and names of any length, constants by reference, apostrophes, and secrets that no base pattern finds."""

import random
import string
import time

import pytest

from prosemill.llm import secrets


def literals(text):
    return {text[a:b] for a, b in secrets.scan(text)["literal"]}


def value(n, seed=3):
    rng = random.Random(seed)
    return "".join(rng.choice(string.ascii_letters + string.digits + ",;!") for _ in range(n))


def test_pairs_after_a_long_literal():
    for quote in "\"'":
        text = f'{{"blob":{quote}{"ab c" * 1500}{quote},"pwd":"Zx81!kQ0w2","nested":{{"private_key":"q9#Lm2@Rt7zz"}}}}'
        assert {"Zx81!kQ0w2", "q9#Lm2@Rt7zz"} <= literals(text)


def test_literals_and_names_of_any_length():
    for n in (12, 1400, 2800, 10000):
        assert literals(f'auth_key = "{value(n)}"') == {value(n)}
    for n in (30, 230, 500, 5000):
        assert literals(f'auth_token_{"q" * n} = "{value(24)}"') == {value(24)}


def test_unclosed_quotes():
    assert literals('x = "abc\npwd = "Zx81!kQ0w2"') == {"Zx81!kQ0w2"}
    for flood in ('"' * 1000001, "a='" * 300000, '"\\' * 500000, "a.b-" * 200000):
        secrets.scan(flood)


@pytest.mark.parametrize("text", [
    "don't set db_auth_key = 'Zx9Qk2Lm8Pq1'", "the dogs' db_auth_key = 'Zx9Qk2Lm8Pq1'", "'tis 5\" wide; db_auth_key = \"Zx9Qk2Lm8Pq1\"",
    "setCredentials('Zx9Qk2Lm8Pq1')", "config['db_auth_key'] = b'Zx9Qk2Lm8Pq1'", "{'db_auth_key': 'Zx9Qk2Lm8Pq1'}", "'db_auth_key' => 'Zx9Qk2Lm8Pq1'",
    "part = 'Zx9Qk2Lm8Pq1'\nauth_key = part", "dbAuthKey: Zx9Qk2Lm8Pq1", "DB_PASSPHRASE=Zx9Qk2Lm8Pq1 run",
])
def test_planted_secrets(text):
    assert literals(text) == {"Zx9Qk2Lm8Pq1"}


@pytest.mark.parametrize("text", [
    "The secret: Everything is fine here", "token_count = 12345678", "password_file = '/etc/app/Zx9Qk2Lm8.txt'", "auth_url = \"https://a.example/x9Qk2\"",
    "auth_key = '${AUTH_KEY_1}'", "auth_key = \"xxxxxxxxxxxx\"", "the key to this is: knowledge", "auth_key = 'several words in it'",
])
def test_values_that_are_no_secrets(text):
    assert literals(text) == set()


def test_constants_are_kept_by_reference():
    began = time.time()
    text = "a = 'Zx9Qk2Lm8Pq1'\n" + "a = a + a\n" * 1000 + "auth_key = a\n"
    assert literals(text) == {"Zx9Qk2Lm8Pq1"}
    text = "a = 'Zx9Qk2Lm8Pq1'\n" + "a = a + 'Kk20Lq'\n" * 50000 + "auth_key = a\n" * 1000
    assert len(secrets.scan(text)["literal"]) == 50001
    text = "".join(f"auth_key_{i} = '{value(20, i)}'\n" for i in range(100000))
    assert len(secrets.scan(text)["literal"]) >= 95000
    assert time.time() - began < 60


def test_letters_outside_ascii_do_not_fold():
    assert secrets.scan("ſecret = abcdefghijklmnop1")["assign"] == []
    assert secrets.scan("toKen = abcdefghijklmnop1")["assign"] == []
    assert len(secrets.scan("SeCret = abcdefghijklmnop1")["assign"]) == 1
