"""Properties of naming over histories, and its rules one by one."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from aliasflow.operators.naming import Ledger, Symbol, invocation, name_symbols

SYMBOLS = [
    Symbol("class:a", "Type", "A"),
    Symbol("class:b", "Type", "B"),
    Symbol("method:a#run", "method", "run"),
    Symbol("field:a#total", "field", "total"),
    Symbol("method:a#getTotal", "method", "getTotal", True, "field:a#total", "total", True, "get"),
    Symbol("local:x", "local", "x", False),
    Symbol("local:y", "local", "y", False),
]
HISTORY = st.lists(st.tuples(st.lists(st.sampled_from(SYMBOLS), min_size=1, max_size=7, unique_by=lambda s: s.key), st.sets(st.sampled_from(["Type1", "Type2", "field3", "getField1", "local4"]))), min_size=1, max_size=6)


@given(HISTORY)
@settings(deadline=None, max_examples=300)
def test_histories(history):
    ledger, words, ever = Ledger(), {}, {}
    for symbols, reserved in history:
        before = ledger
        named, ledger, _ = invocation(ledger, symbols, reserved)
        assert before.number <= ledger.number and before.names.items() <= ledger.names.items()  # append-only
        assert len({w for _, w in named}) == len(named)  # injective
        for s, (key, word) in zip(symbols, named, strict=True):
            assert words.setdefault(key, word) == word or not s.qualified  # stable
            assert s.key in before.names or word not in reserved
            if s.qualified:
                assert ledger.names[key][0] == word
            else:
                assert key not in ledger.names
                assert ever.setdefault(word, key) == key and word not in {w for w, _ in before.names.values()}  # no number twice
    assert len({w for w, _ in ledger.names.values()}) == len(ledger.names)


def test_accessors_siblings_stems_and_literals():
    getter = Symbol("m#getTotal", "method", "getTotal", True, "f#total", "total", True, "get")
    setter = Symbol("m#setTotal", "method", "setTotal", True, "f#total", "total", True, "set")
    getter.siblings = [setter]
    named, ledger, made = invocation(Ledger(), [getter, Symbol("", "str", "x", literal=True), Symbol("", "str", "x", literal=True)], set())
    assert [w for _, w in named] == ["getField1", "str2", "str3"] and made == {"m#getTotal"}
    assert ledger.names == {"f#total": ("field1", "total"), "m#getTotal": ("getField1", "getTotal"), "m#setTotal": ("setField1", "setTotal")} and ledger.number == 4
    named, *_ = invocation(Ledger(), [getter], {"getField1"})
    assert named == [("m#getTotal", "method2")]
    named, ledger, _ = invocation(Ledger(), [Symbol("f#total", "field", "total", stem="sum"), getter], set())
    assert [w for _, w in named] == ["sum1", "getSum1"] and ledger.stems == {"sum", "getSum", "setSum"}


def test_grouped_fold_equals_the_fold(spark):
    rows = [(f"p{p}", seq, i, s.key, s.namespace, s.original, s.qualified, s.field_key, s.field_name, s.prefix, ["Type2"]) for p in range(3) for seq in range(3) for i, s in enumerate(SYMBOLS[seq : seq + 4 + p])]
    frame = spark.createDataFrame(rows, "project_id string, seq long, start int, key string, namespace string, original string, qualified boolean, field_key string, field_name string, prefix string, reserved array<string>")
    got = {(r.project_id, r.seq, r.key): r.placeholder for r in name_symbols(frame).collect()}
    for p in range(3):
        ledger = Ledger()
        for seq in range(3):
            named, ledger, _ = invocation(ledger, SYMBOLS[seq : seq + 4 + p], ["Type2"])
            assert all(got[f"p{p}", seq, k] == w for k, w in named)
    assert all(re.search(r"\d$", w) for w in got.values())
