"""Forms of assignment that the secret lexer reads, and names of code that it leaves alone."""

import random
import time

import pytest

from lexweave.llm import secretscan

KEY = "hV7/kQ2x9Lm4Zp1s"


def found(code):
    return [code[a:b] for a, b, _ in secretscan.literal_spans(code)]


@pytest.mark.parametrize(
    "code",
    [
        'os.environ["API_KEY"] = "@"', "config['db']['password'] = '@'", 'headers["Authorization"] = "Bearer @"', 'client.set_password("@")', 'setPassword(\n  "@")', 'vault.addToken("name", "@")',
        'password = ("@")', 'password = ["@"]', 'passwords = [\n  "@",\n]', 'password = str("@")', 'password = os.getenv("PW", "@")', 'password = os.environ.get("DATABASE_PASSWORD", "@")', 'api_key = decode(wrap("@"))',
        'password = b"@"', "<password><![CDATA[@]]></password>", '<password>\n<![CDATA[@]]>\n</password>', 'password = base\nbase = "@"\n', 'password = middle\nmiddle = base\nbase = "@"\n',
        'login(user="x", password="@")', 'db = {"password": "@", "host": "localhost"}', 'connect("host", token="@", retries=3)',
    ],
)
def test_forms_with_one_secret(code):
    assert [s.removeprefix("Bearer ") for s in found(code.replace("@", KEY))] == [KEY]


def test_strings_side_by_side():
    assert found(f'password = "abc" "{KEY}"') == found(f'password = ("abc"\n  "{KEY}")') == ["abc", KEY]


@pytest.mark.parametrize(
    "code",
    [
        "password = os.environ", "token = get_current_token_value", "token=getCurrentTokenValue()", "f(token=current_token_value)", "password = self.read_password()", 'password = os.environ["DATABASE_PASSWORD"]',
        'password = os.getenv("DATABASE_PASSWORD")', 'token = get_secret("projects/foo/secrets/bar")', 'get_secret("projects/foo/secrets/Bar7")', 'secret = config.get("service-secret-key")', "password = a\na = password\n", "password = unknown\n", "password = (", "password = [", 'password = f(g("',
    ],
)
def test_names_of_code_are_no_literals(code):
    assert found(code) == []


@pytest.mark.parametrize("code", ["password: correcthorsebattery", "  - password: correcthorsebattery\n", "export DB_PASSWORD=correcthorsebattery\n", "password: correcthorsebattery # here\n"])
def test_bare_words_of_configuration(code):
    assert found(code) == ["correcthorsebattery"]


@pytest.mark.parametrize("piece", ['a = ["b=["]\n', "a=[", 'x = f(password="K", ', "<a><![CDATA[ ", 'password = ("a" ', 'set_password("abcdefgh12", ', "password = a\n", "a[", 'a["k"]', "password=((("])
def test_time_is_linear(piece):
    began = time.time()
    found(piece * 100_000)
    assert time.time() - began < 30


def test_spans_of_random_code_are_in_order_and_inside():
    rnd = random.Random(8)
    parts = ["password", "token", " = ", ": ", "=", '"', "'", KEY, "(", ")", "[", "]", "{", "}", ",", "\n", "+", " ", "get_x", "b", "<a>", "</a>", "<![CDATA[", "]]>", '"""', "|", "\\", ".", "#", "- "]
    for _ in range(3000):
        code = "".join(rnd.choices(parts, k=rnd.randint(0, 40)))
        spans = secretscan.literal_spans(code)
        assert spans == sorted(spans) and all(0 <= a < b <= len(code) and 0.5 <= s <= 1 for a, b, s in spans)
