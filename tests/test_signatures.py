"""Signed requests: fields, bases, keys and verdicts by known answers."""

import base64
import datetime

import pytest
from conftest import SF

from clientlens.functions import structured as st
from clientlens.operators import signatures
from clientlens.plans import signed as made

# test vectors of the published standards (signature, key and message)
EMPTY = ("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
HTTP_KEY = "JrQLj5P_89iXES9-vFgrIy29clF9CC_oPPsw3c5D0bs"
HTTP_SIGNATURE = "wqcAqbmYJ2ji2glfAMaRy4gruYYnx2nEFN2HN6jrnDnQCK1u02Gb04v9EDgwUPiu4A0w6vuQv5lIp5WPpBKRCw=="
HTTP_BASE = '"date": Tue, 20 Apr 2021 02:07:55 GMT\n"@method": POST\n"@path": /foo\n"@authority": example.com\n"content-type": application/json\n"content-length": 18\n"@signature-params": ("date" "@method" "@path" "@authority" "content-type" "content-length");created=1618884473;keyid="test-key-ed25519"'


def test_known_signatures():
    s, k = map(bytes.fromhex, EMPTY)
    assert st.valid_signature(k, b"", s) and not st.valid_signature(k, b".", s)
    key, s = base64.urlsafe_b64decode(HTTP_KEY + "="), base64.b64decode(HTTP_SIGNATURE)
    assert st.valid_signature(key, HTTP_BASE.encode(), s) and not st.valid_signature(key, HTTP_BASE.encode(), s[:-1] + bytes([s[-1] ^ 1]))
    for bad in (b"", s[:32] + (int.from_bytes(s[32:], "little") + st.ORDER).to_bytes(32, "little"), s[:63]):
        assert not st.valid_signature(key, HTTP_BASE.encode(), bad)
    assert not st.valid_signature(b"\xff" * 32, b"", s) and not st.valid_signature(b"x", b"", s)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a=1, b=?0;x, c", {"a": (1, {}), "b": (False, {"x": True}), "c": (True, {})}),
        ('a=("x" y;p=1.50);k="q\\"z", a=:aGk=:', {"a": (b"hi", {})}),
        ("a=(),b=-12.5", {"a": ([], {}), "b": (-12.5, {})}),
        ("", None), ("a=", None), ("a=(1 2", None), ("a=1,", None), ("A=1", None), ('a="\x07"', None), ('a=("x""y")', None), ("a=1 b=2", None), ("é=1", None),
    ],
)
def test_dictionaries(text, want):
    assert st.dictionary(text) == want


def test_members_are_written_as_signers_do():
    text = '("@authority" "x";sf tok);created=1;n="a\\"b";f=?0;t;d=1.5;b=:aGk=:'
    assert st.member_text(st.dictionary("s=  ".strip() + text)["s"]) == text


ENTRY = "seq long, client_ip string, client_ua string, remote_host string, ts timestamp, method string, path string, host_header string, scheme string, extra map<string,string>"
AT = datetime.datetime.fromtimestamp(1_700_000_000, datetime.UTC)


def request(seq, ip="10.0.0.1", seed=0, nonce=None, expires=1_700_000_060, covered='"@authority" "@path"', sign_path="/p", host="E.org:443", scheme="https", ts=AT, drop=(), tag="web-bot-auth"):
    seed = made.SEEDS[seed]
    params = f'({covered});created=1700000000;expires={expires};keyid="{made._keyid(seed)}"' + (f';nonce="{nonce}"' if nonce else "") + f';tag="{tag}"'
    base = f'"@authority": e.org\n"@path": {sign_path}\n"@signature-params": {params}'
    extra = {"Signature-Input": f"s={params}", "Signature": f"s=:{base64.b64encode(made.sign(seed, base.encode())).decode()}:"}
    return (seq, ip, "ua", ip, ts, "GET", "/p", host, scheme, {k: v for k, v in extra.items() if k not in drop})


def judged(spark, rows):
    sets = spark.createDataFrame([(f'{{"keys":[{{"kty":"OKP","crv":"Ed25519","x":"{made._public(made.SEEDS[0])}"}},{{"kty":"OKP","crv":"Ed25519","x":"not/base64url"}}]}}',), (None,), ("[]",)], "jwks string")
    c = signatures.with_base(signatures.claims(spark.createDataFrame(rows, ENTRY)))
    return c, signatures.with_status(c, signatures.keys(sets))


def test_statuses(spark):
    rows = [
        request(0), request(1, sign_path="/q"), request(2, expires=1_699_999_999), request(3, ts=None), request(4, seed=1), request(5, covered='"@authority" "content-digest"'),
        request(6, covered='"@authority" "x-other"'), request(7, drop=["Signature"]), request(8, tag="other"), request(9, host=None), request(10, host="e.org:80", scheme="http"),
    ]
    rows.append((11, "10.0.0.1", "ua", "10.0.0.1", AT, "GET", "/p", "e.org", None, {"Signature-Input": "((", "Signature": "x"}))
    rows.append((12, "10.0.0.1", "ua", "10.0.0.1", AT, "GET", "/p", "e.org", None, {}))
    rows.append((13, *request(0)[1:9], {**request(0)[9], "Signature": "other=:AA==:"}))
    c, j = judged(spark, rows)
    assert {r["seq"]: r["status"] for r in j.collect()} == {0: "verified", 1: "forged", 2: "expired", 3: "expired", 4: "unverifiable", 5: "unverifiable", 6: "unverifiable", 9: "unverifiable", 10: "verified"}
    why = {r["seq"]: r["reason"] for r in j.collect()}
    assert "body" in why[5] and "x-other" in why[6] and "@authority" in why[9] and why[4] == "key unavailable"
    assert {r["seq"]: r["problem"] for r in c.where("problem is not null").collect()} == {7: signatures.NOT_LOGGED, 11: signatures.NOT_PARSED, 13: signatures.NO_LABEL}
    none, nothing = judged(spark, rows[12:13])
    assert none.count() == nothing.count() == 0


def test_clients(spark):
    rows = [request(0, "a"), request(1, "a", sign_path="/q"), request(2, "b", nonce="n1"), request(3, "c", nonce="n1"), request(4, "d", nonce="n2"), request(5, "d", nonce="n2", expires=1_700_000_099), request(6, "e", drop=["Signature"])]
    # past the first eight signatures nothing counts
    rows += [request(10 + k, "f", expires=1_700_000_100 + k) for k in range(8)] + [request(20, "f", sign_path="/q")]
    c, j = judged(spark, rows)
    got = {r["client_ip"]: (r["wba"], ",".join(r["wba_tags"])) for r in signatures.verdicts(c, j).collect()}
    assert got == {
        "a": ("verified", "wba-mixed,wba-verified"), "b": ("verified", "wba-replay,wba-verified"), "c": ("verified", "wba-replay,wba-verified"),
        "d": ("verified", "wba-nonce-reuse,wba-verified"), "e": ("unverifiable", "wba-unverified"), "f": ("verified", "wba-verified"),
    }


@pytest.mark.parametrize(("text", "want"), [('"https://a.org"', "https://a.org"), ('k="https://b.org";p', "https://b.org"), ("https://c.org, x", "https://c.org"), ("", None), (None, None), ("tok", None), ("7", None)])
def test_agent_urls(text, want):
    assert signatures._agent_url(text) == want


def test_multiples_are_those_of_doubling():
    table = st.base_multiples()
    for n in (0, 1, 15, 16, st.ORDER - 1, (1 << 255) - 19):
        assert st.compress(st.times_known(n, table)) == st.compress(st.times(n, st.base_point()))
    key = base64.urlsafe_b64decode(HTTP_KEY + "=")
    s = base64.b64decode(HTTP_SIGNATURE)
    for often in (False, True):
        assert st.valid_signature(key, HTTP_BASE.encode(), s, often) and not st.valid_signature(key, HTTP_BASE.encode() + b".", s, often)
        assert not st.valid_signature(b"\xff" * 32, b"", s, often)


def test_requests_are_signed_and_checked_once(spark, monkeypatch):
    made_times = spark.sparkContext.accumulator(0)
    own = made.sign
    monkeypatch.setattr(made, "sign", lambda *a: (made_times.add(1), own(*a))[1])
    assert made.signed_clients(spark, SF).count()
    assert made_times.value == spark.read.parquet(f"{SF}/customer.parquet").count()
