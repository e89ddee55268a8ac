import pytest

from gitloom.functions.pysource import read_definitions


def names(source):
    return [(d["kind"], d["qualname"]) for d in read_definitions(source)["definitions"]]


def fingerprint(source, at=0):
    return read_definitions(source)["definitions"][at]["fingerprint"]


def test_names_follow_their_scopes():
    source = b"""
class Cache:
    @property
    def get(self):
        async def inner(): pass
if True:
    def f(): pass
else:
    def f(): pass
try:
    pass
except E:
    class Late: pass
"""
    assert names(source) == [
        ("class", "Cache"), ("function", "Cache.get"), ("async function", "Cache.get.<locals>.inner"),
        ("function", "f"), ("function", "f"), ("class", "Late"),
    ]


def test_decorators_are_named():
    source = b'@a.b("x")\n@plain\n@f().g\ndef h(): pass\n'
    found = read_definitions(source)["definitions"][0]["decorators"]
    assert found[:2] == ["a.b", "plain"] and found[2].startswith("Attribute(")


@pytest.mark.parametrize(
    "one, other, same",
    [
        (b"def f(a): return a", b"\n\ndef g(a):\n    return a  # note", True),
        (b"def f(a): return a", b"def f(a): return b", False),
        (b"def f(a): return a", b"def f(b): return a", False),
        (b"def f(a): return a", b"def f(a) -> int: return a", False),
        (b"def f(a): return a", b"async def f(a): return a", False),
        (b"class A(B): pass", b"class C(B): pass", True),
        (b"class A(B): pass", b"class A(B, m=1): pass", False),
        (b"@x(1)\ndef f(): pass", b"@x(2)\ndef f(): pass", False),
    ],
)
def test_fingerprints(one, other, same):
    assert (fingerprint(one) == fingerprint(other)) is same


@pytest.mark.parametrize("source", [b"print 'old'", b"def f(:\n", b"a\0b"])
def test_unreadable_sources_say_why(source):
    found = read_definitions(source)
    assert found["definitions"] is None and "Error: " in found["parse_error"]


def test_empty_and_encoded_sources_are_read():
    assert read_definitions(b"")["definitions"] == []
    assert names("# -*- coding: latin-1 -*-\ndef f(): return 'é'\n".encode("latin-1")) == [("function", "f")]


def test_deep_sources_are_read():
    source = "def f():\n    return " + " + ".join("x" for _ in range(2000)) + "\n"
    found = read_definitions(source.encode())
    assert found["definitions"] or "Error" in found["parse_error"]
