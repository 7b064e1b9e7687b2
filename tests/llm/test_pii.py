"""Spans against the plain patterns, checksums, and scores by context."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.pii import base_spans, luhn, mod97, pii_digest, spans_of
from tests.llm.cases import frame, tables

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def sum_of_luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and sum_of_luhn(digits), 9 <= len(digits) <= 15)[kind]
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PIECES = st.sampled_from(["a", "b@", "@", "c.d", ".", "-", "+", "1", "22", "255", "256.", "1.2.3.4", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (30) 123-4567", " ", "x@y.zz", "é", "x@y", "..", "%", "(", "\n", "GB82 WEST 1234 5698 7654 32", "000000000000"])


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans(text):
    assert base_spans(text) == brute(text)
    got = [(s, k, e) for s, k, e, _ in spans_of(text)]
    assert [x for x in got if x[1] < 4] == brute(text)


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33")


def kinds(text):
    return [k for _, k, _, _ in spans_of(text)]


def test_added_kinds_and_context():
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 please") == [4]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 please") == []
    assert kinds("her ssn is 123-45-6789.") == [5] and kinds("invoice 123-45-6789") == [] and kinds("ssn 666-45-6789") == []
    assert kinds("please call 555-867-5309 soon") == [6] and kinds("see 555-867-5309 there") == []
    near, far = (next(s for _, k, _, s in spans_of(t) if k == 1) for t in ("host 10.0.0.1 is up", "version 10.0.0.1 is out"))
    assert near > far


def test_long_runs_are_quick():
    text = "1" * 200_000 + " " + "a" * 200_000 + "@ " + "+1" + " (" * 100_000
    assert base_spans(text) == []


def test_rows(spark):
    more = [(50, "mail x@y.zz or 1.2.3.4, é +49 30 1234567", "en", "a", 1), (50, "mail x@y.zz or 1.2.3.4, é +49 30 1234567", "en", "a", 1), (51, "x " * 30_000 + "a@b.cc", "en", "a", 1)]
    for df, rows in [*tables(spark), (frame(spark, more), more)]:
        got = pii_digest(df).collect()
        assert all(r.n_spans == len(r.spans.split(",")) if r.spans else r.n_spans == 0 for r in got)
        want = []
        for i, x, *_ in rows:
            base = brute(x or "")
            listed = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in base)
            want.append((str(i), *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted(want)


def test_accounts_before_capitals_and_numbers():
    account = "GB82 WEST 1234 5698 7654 32"

    def accounts(text):
        return [text[s:e] for s, k, e, _ in spans_of(text) if k == 4]

    for after in (" EUR 500 now", " BIC WESTGB2L", " 2024", " 1 000", " DE", "", ".", "\n77"):
        assert accounts("pay to " + account + after) == [account]
    # Right after one another, after something that only looks like a start, and written without blanks.
    assert accounts(f"pay {account} {account} DE89 3704 0044 0532 0130 00 EUR 5") == [account, account, "DE89 3704 0044 0532 0130 00"]
    assert accounts(f"ref AB12 {account} 7") == [account]
    assert accounts("to NO9386011117947 AND GB82WEST12345698765432 EUR") == ["NO9386011117947", "GB82WEST12345698765432"]
    # A country that is not listed: the longest reading that passes.
    body = "1234567890123"
    unlisted = next(f"ZZ{n:02} {body}" for n in range(2, 99) if mod97(f"ZZ{n:02} {body}"))
    assert accounts(f"pay {unlisted} EUR, please") == [unlisted]
    # The number must not go on, and a listed country's must be whole.
    assert accounts("pay GB82WEST12345698765432EUR") == [] and accounts("pay GB82 WEST 1234 5698 7654 please") == []


def test_secrets():
    def secrets(text):
        return [text[s:e] for s, k, e, _ in spans_of(text) if k == 7]

    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'the token = "{value}" of', f"API_KEY: {value}", f"password={value}", f"Secret key : '{value}'"):
        assert secrets(text) == [value]
    # A digit run in a secret may pass for a card; both are told.
    assert kinds('token = "ab4539578763621486cdef0"') == [7, 2]
    key = "AKIA" + "Q7ZR2M5XK3WTB9DN"
    assert secrets(f"{key} and {key}.") == [key, key] and secrets(key + "AA") == []
    assert secrets("-----BEGIN RSA PRIVATE KEY-----") == ["-----BEGIN RSA PRIVATE KEY-----"]
    for text in ("token = aaaaaaaaaaaaaaaaaaaa1", "the token is somewhat-longer-than-sixteen", "token: somewhat-longer-than-sixteen", f"commit {value}", "token = short1"):
        assert secrets(text) == []


def test_addresses_with_many_zeros():
    for text in ("0" * 5000 + ".1.1.1", "0" * 5000 + "255.1.1.1"):
        assert base_spans(text) == [(0, 1, len(text))]
    assert base_spans("1.1.1." + "0" * 5000 + "256") == [] and base_spans("1." + "9" * 5000 + ".1.1") == []
