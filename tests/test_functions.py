import pytest
from pyspark.sql import functions as F

from tallyglass.functions import display as D
from tallyglass.functions import text as X
from tallyglass.functions import times as TM

DURATIONS = {
    "PT0S": 0, "PT7.081S": 7081, "PT0.25S": 250, "PT9M": 540_000, "PT3H": 10_800_000, "PT2H41M6.75S": 9_666_750,
    "PT40H": 144_000_000, "-PT4.2S": -4200, "": 0, "soon": 0, "7.081S": 0, "P3Q": 0, "PTZ": 0, "P2D": 172_800_000,
    "PT2D": 172_800_000, "P2M": 0, "P5W": 0, "PT4-6S": 0, "P": 0, "PT": 0, "PT3S4S": 7000, "PT-2.25S": -2250, "+PT6S": 6000,
    "PT4.003S": 4003, "8.5": 0, "PT6.S": 6000, "PT.75S": 750, "PT3.4.5S": 0, "pt6s": 0, "P2DT3H": 183_600_000,
}


def test_iso_durations(one):
    got = one(list(DURATIONS), "string", TM.iso_duration_ms("c"))
    assert dict(zip(DURATIONS, got)) == DURATIONS


def test_json_durations(one):
    cases = {
        '"PT6.25S"': 6250, "4.5": 4500, '"4.5"': 0, "null": 0, "false": 0, '{"s":6}': 0, "8": 8000,
        "2.5E2": 250_000, "1e250": 0, "-4.5": -4500, '"later"': 0, "[6]": 0,
    }
    assert one(list(cases), "string", TM.duration_ms("parse_json(c)")) == list(cases.values())


def test_rfc3339_is_strict(one):
    good = ["2024-01-15T10:30:00.000Z", "2024-01-15T10:30:00+02:00", "2024-01-15T10:30:00.123456789Z"]
    bad = ["2024-01-15", "2024-01-15 10:30:00", "2024-01-15T25:30:00Z", "2024-01-15T10:30:00", "x"]
    instants = one(good + bad, "string", TM.rfc3339("c"))
    assert [t is None for t in instants] == [False] * 3 + [True] * 5
    assert instants[1].hour == 8 and instants[2].microsecond == 123456
    wrong = one([*good, *bad, None], "string", F.expr(TM.bad_rfc3339_sql("c")))
    assert wrong == [False] * 3 + [True] * 5 + [False]


def test_query_id_day(one):
    ids = ["20250407_213000_q0001", "", "2025", "monday_0007", "2025xy07_q", "none", "20250431_q"]
    days = one(ids, "string", TM.query_id_day(F.col("c")))
    assert [str(d) if d else None for d in days] == ["2025-04-07"] + [None] * 6


def _truncated(text: str, limit: int) -> str:
    raw = text.encode()
    if len(raw) <= limit:
        return text
    if limit <= 0:
        return ""

    def back(cut):
        while cut > 0 and (raw[cut] & 0xC0) == 0x80:
            cut -= 1
        return cut

    cut = limit - len(f"\n…[truncated {len(raw)} bytes]".encode())
    if cut <= 0:
        return raw[: back(limit)].decode()
    cut = back(cut)
    return raw[:cut].decode() + f"\n…[truncated {len(raw) - cut} bytes]"


@pytest.mark.parametrize("text", ["é" * 300, "x" * 1000, "a€😀" * 60, "short", ""])
def test_truncation_sweep(one, text):
    limits = range(-1, 121)
    (got,) = one([text], "string", *[X.truncate_bytes("c", n) for n in limits])
    for n, value in zip(limits, got):
        assert value == _truncated(text, n), n
        assert len(value.encode()) <= max(n, 0) or value == text


@pytest.mark.parametrize("text", ["é" * 50, "a€😀" * 20, "plain text " * 10])
def test_byte_prefix_sweep(one, text):
    limits = range(1, 60)
    (got,) = one([text], "string", *[X.byte_prefix("c", n) for n in limits])
    for n, value in zip(limits, got):
        assert text.startswith(value) and n - 3 <= len(value.encode()) <= n


def test_whitespace_is_unicode(one):
    spaces = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    texts = [f"{chr(s)}a{chr(s)} {chr(s)}b{chr(s)}" for s in spaces]
    assert one(texts, "string", X.one_line(F.col("c"))) == ["a b"] * len(texts)
    assert one(["a​b", "a\n  b\t c", " ", ""], "string", X.one_line(F.col("c"))) == ["a​b", "a b c", "", ""]


def test_preview(one):
    text = "  select\n\t1 " + "é" * 200
    (got,) = one([text], "string", X.query_preview("c", 20))
    assert got == "select 1 " + "é" * 5 and len(got.encode()) == 19
    assert one([" a  b "], "string", X.query_preview("c", 0)) == ["a b"]


def test_ellipsize(one):
    c = F.col("c")
    assert one(["hello world"], "string", *[X.ellipsize(c, n) for n in (-1, 0, 1, 5, 11)]) == [
        ("", "", "h", "hell…", "hello world")
    ]


def test_human_forms(one):
    c = F.col("c")
    assert one([0, -8, 999, 2345, 61_000, 7_500_000], "bigint", D.human_ms_cli(c)) == ["0", "0", "999ms", "2.3s", "1m1s", "2h5m"]
    assert one([2345, 59_999], "bigint", D.human_ms_ui(c)) == ["2.35s", "60.00s"]
    assert one([700, 3072, 5 * 2**20 + 2**19, 7 * 2**30, 9 * 2**40], "bigint", D.human_bytes_cli(c)) == [
        "700B", "3.0KiB", "5.5MiB", "7.0GiB", "9.0TiB"
    ]
    # Fixed points of the format: the largest numbers of their kind.
    top, below = 2**63 - 1, 2**60 - 1
    assert one([700, 2560, 0, top, below], "bigint", D.human_bytes_ui(c)) == ["700 B", "2.5 KiB", "0", "8.0 EiB", "1024.0 PiB"]
    assert one([top, below], "bigint", D.human_bytes_cli(c)) == ["8192.0PiB", "1024.0PiB"]
    assert one([6001215, -5998, 0], "bigint", D.human_count(c)) == ["6,001,215", "-5,998", "0"]
    assert one([None], "bigint", D.or_placeholder(D.human_count(c))) == ["-"]


def test_comma_int(one):
    assert one(["6,001,215", "37", "", ",", "88888888888888888888"], "string", D.parse_comma_int("c")) == [6001215, 37, 0, 0, 2**63 - 1]
