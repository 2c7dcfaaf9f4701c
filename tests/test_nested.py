import json

from hypothesis import given, settings, strategies as st

from carex.operators.nested import ALWAYS_LISTS, element_rows, list_elements

NAMES = st.sampled_from(["a", "b", "coding", "telecom", "line", "x.y", 'q"t', "é", "\\", ""])
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.floats(-2, 2) | st.text(alphabet='ab"\\{}[],: \n\té', max_size=6),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(NAMES, x, max_size=4),
    max_leaves=25,
)


def brute(doc):
    out = []

    def items(values, path, parent):
        for i, x in enumerate(values):
            p = f"{path}[{i}]"
            if isinstance(x, list):
                items(x, p, parent)
            elif x is not None:
                out.append((p, parent))
                walk(x, p, p)

    def walk(v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                q = f"{path}.{k}" if path else k
                if isinstance(x, list):
                    items(x, q, parent)
                elif k in ALWAYS_LISTS:
                    items([x], q, parent)
                else:
                    walk(x, q, parent)

    if isinstance(doc, list):
        items(doc, "", "")
    else:
        walk(doc, "", "")
    return sorted(out)


def rows(documents):
    doc, node, parent = element_rows(documents)
    out = [[] for _ in documents]
    for d, n, p in zip(doc.tolist(), node.to_pylist(), parent.to_pylist()):
        out[d].append((n, p))
    return [sorted(x) for x in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=5), st.sampled_from([None, 1, 3]), st.booleans())
def test_equals_a_walk_over_parsed_documents(values, indent, ascii_only):
    assert rows([json.dumps(v, indent=indent, ensure_ascii=ascii_only) for v in values]) == [brute(v) for v in values]


def test_unreadable_neighbours_do_not_matter():
    good = '{"a":[1,{"b":[2]}]}'
    for bad in ('{"a":[1', '{"a":[1]}}', '{"a":1} x"', '"', '{"a":"x', "]["):
        assert rows([bad, good, bad]) == [[], brute(json.loads(good)), []]


def test_wrapped_null_and_unreadable_rows(spark):
    doc = '{"coding":"x","l":[null,1]}'
    data = [(1, doc), (2, json.dumps(doc)), (3, None), (4, "{"), (5, ""), (6, "7"), (1, doc)]
    df = spark.createDataFrame([(*r, "d") for r in data], "id long, resource string, document string")
    got = sorted(tuple(r) for r in list_elements(df).collect())
    each = [("coding[0]", ""), ("l[1]", "")]
    assert got == sorted((k, *e) for k in (1, 1, 2) for e in each)
    assert list_elements(df.limit(0)).count() == 0


def test_deep_and_long_documents():
    deep = '{"a":[' * 60 + "1" + "]}" * 60
    long = json.dumps({"a": [{"b": "x" * 1000, "c": [i]} for i in range(3000)]})
    assert rows([deep, long]) == [brute(json.loads(deep)), brute(json.loads(long))]
