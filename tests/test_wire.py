import json

import pytest

from verdimill.questions import Choice, Noul, Raw, Score
from verdimill.wire import DIALECTS, Dialect, WireError, decode_response, encode_request, flagged_of, media_blocks

QS = {"b": Choice("Which?", (("y", "why"), ("x", None))), "a": Noul("Is it?", true={"k": 1}), "c": Score("How much?", ("lo", {"t": "hi"}))}


def test_native_request_and_response():
    m = json.loads(encode_request({"z": 1}, QS, "m", {"q": 1, "p": 2}))
    assert list(m) == ["state", "model", "questions", "p", "q"] and list(m["questions"]) == ["a", "b", "c"]
    assert list(m["questions"]["b"]["criteria"]) == ["y", "x"]
    r = decode_response('{"model": "jv", "answers": {"d": {"type": "choice", "choice": "x", "probabilities": {"x": 0.91, "y": 0.09}, "confidence": 0.87}, "e": {"noul": "no"}, "f": 3, "g": {"type": "noul"}}, "usage": {"input_tokens": 268}, "id": 7}', {"e": Noul("?")})
    assert r.model == "jv" and r.answers["d"]["probabilities"] == {"x": 0.91, "y": 0.09} and r.usage["input_tokens"] == 268 and r.extra == {"id": 7}
    assert r.answers["e"]["decode_error"] and r.answers["f"]["decode_error"] and r.answers["g"]["missing"] == ["noul"]
    assert decode_response('{"model": 5}').extra == {"model": 5}
    for bad in ("[]", "{", '{"answers": []}', '{"answers": {"a": {"type": "noul", "noul": 1e400}}}'):
        with pytest.raises(WireError):
            decode_response(bad)


def test_bad_requests():
    for state, qs, extra in ((None, QS, {}), ("s", {}, {}), ("s", {"": Noul("?")}, {}), ("s", {"a": Score("?", ("x",))}, {}), ("s", QS, {"state": 1}), (b"s", QS, {})):
        with pytest.raises(WireError):
            encode_request(state, qs, extra=extra)


def test_list_dialect():
    d = DIALECTS["list"]
    m = json.loads(d.request({"t": 1}, QS, "m"))
    assert m["input"] == '{"t":1}' and [q["name"] for q in m["questions"]] == ["a", "b", "c"]
    assert m["questions"][0]["type"] == "predicate" and m["questions"][0]["instructions"].endswith('Yes means: {"k":1}')
    assert m["questions"][1]["choices"] == [{"value": "y", "description": "why"}, {"value": "x"}]
    r = d.response(json.dumps({"answers": [{"name": "a", "type": "predicate", "probability": 0.4}, {"name": "c", "type": "score", "score": 0.3, "confidence": 0.5, "probabilities": [{"value": 0, "label": "lo", "probability": 0.7}, {"value": 1, "label": "x", "probability": 0.3}]}]}), QS)
    assert r.answers["a"]["noul"] == 0.4 and r.answers["c"]["legend"] == {"0": "lo", "1": {"t": "hi"}} and r.answers["c"]["probabilities"] == {"0": 0.7, "1": 0.3}
    for bad in ({"answers": {}}, {"answers": [{}]}, {"answers": [{"name": "a"}, {"name": "a"}]}):
        with pytest.raises(WireError):
            d.response(json.dumps(bad), QS)


def test_map_dialect_and_limits():
    d = DIALECTS["map"]
    m = json.loads(d.request("s", QS, "m", {"model": "no", "k": 1}))
    assert m["model"] == "m" and m["k"] == 1 and m["questions"]["a"]["criteria"] == {"true_description": '{"k":1}'} and m["questions"]["c"]["criteria"] == ["lo", '{"t":"hi"}']
    r = d.response('{"answers": {"c": {"type": "score", "score": 1, "confidence": 1, "probabilities": {"0": 0, "1": 1}}}, "usage": {"total_input_tokens": 5}}', QS, "m")
    assert r.model == "m" and r.usage["input_tokens"] == 5 and r.answers["c"]["legend"]["0"] == "lo"
    with pytest.raises(WireError):
        d.request("s", {"a b": Noul("?")})
    native = Dialect(models=("one",))
    for qs, model in ((QS, "two"), ({f"k{i}": Noul("?") for i in range(65)}, "one"), ({"a": Score("?", tuple("abcdefghijk"))}, "one"), ({"a": Raw("vote", '{"type":"vote"}')}, "one"), ({"a": Choice("?", (("x", None),))}, "one")):
        with pytest.raises(WireError):
            native.request("s", qs, model)
    assert native.response('{"result": {"answers": {"a": {"type": "noul", "noul": 1}}}}', QS).answers["a"]["noul"] == 1


def test_media_and_flags():
    b = media_blocks("s", [("image/png", b"abc"), ("image/png", "http://x")])
    assert b[1]["data"] == "YWJj" and b[2]["url"] == "http://x"
    with pytest.raises(WireError):
        media_blocks("s", [("image/png", b"x" * 100)], 50)
    assert flagged_of({"a": {"noul": 0.7}, "b": {"noul": 0.9}, "c": {}}, {"a": None, "b": 0.8, "c": 0.1, "d": 0.1}) == ["b", "a"]
