import json

from hypothesis import given
from hypothesis import strategies as st

from gleaner import config as c


def test_weights():
    assert [round(c.to_factor(w), 2) for w in (0, 3, 5, 7, 10, 11, -1, 2.5)] == [0, 0.45, 0.75, 1.05, 1.5, 1.5, 0, 0.45]
    assert [c.from_factor(f) for f in (0.3, 0.75, 1.05, 10)] == [2, 5, 7, 10]
    assert c.clamp_weight(float("nan")) == c.clamp_weight("5") == c.clamp_weight(None) == 0
    assert c.clamp_relevance("x") == 10 and c.clamp_relevance(-3) == 0


def test_load_forms():
    assert c.from_document(None) == c.Settings()
    flat = c.from_document({"folders": [{"path": "a/", "groupId": "external", "weight": 12}, {"path": 3}, None], "excludedFolders": ["x/", 1], "searchMode": "tag", "relevanceThreshold": 7, "doctrineSynonyms": {"k": [" ab ", "c", 1], "z": 3}})
    assert flat.folders == (c.Folder("a/", "external", 10),) and flat.excluded == ("x/",) and flat.mode == "tag" and flat.relevance == 7 and flat.synonyms == {"k": ["ab"]}
    old = c.from_document({"categories": [{"id": "raw"}, {"id": "own", "isExternal": False}, {"id": "e", "groupId": "external"}], "folders": [{"path": "a", "categoryId": "raw", "weight": 0.75}, {"path": "b", "categoryId": "own"}, {"path": "c", "categoryId": "?", "weight": 1.5}, {"path": "d", "categoryId": "e", "weight": 0}]})
    assert old.folders == (c.Folder("a", "external", 5), c.Folder("b", "internal", 5), c.Folder("c", "internal", 10), c.Folder("d", "external", 0))
    oldest = c.from_document({"folderWeights": [{"path": "a", "weight": 0.3}, {"path": "b"}]})
    assert oldest.folders == (c.Folder("a", "internal", 2),) and oldest.excluded == (".trash/",)
    assert c.from_categories({"settingsVersion": 2, "categories": [], "folders": []}) is None


def test_save_and_load(tmp_path):
    s = c.add_folder(c.exclude(c.Settings(), "old/"), " notes/ ", "external", 7)
    c.save(s, str(tmp_path / "s.json"))
    assert c.load(str(tmp_path / "s.json")) == s
    assert c.load(str(tmp_path / "none.json")) == c.Settings()
    assert json.load(open(tmp_path / "s.json"))["settingsVersion"] == 2


def test_edits():
    s = c.add_folder(c.Settings(), "a/")
    assert c.add_folder(s, "a/ ") is s and c.add_folder(s, " ") is s and s.folders[0].weight == 5
    assert c.edit_folder(s, "a/", weight=99, group_id="external").folders == (c.Folder("a/", "external", 10),)
    assert c.drop_folder(s, "a/").folders == ()
    assert c.exclude(s, ".trash/") is s and c.include(s, ".trash/").excluded == ()
    assert c.fingerprint(s) == "a/|internal|5||.trash/" and c.reset() == c.Settings()


def test_folder_factor():
    s = c.Settings(folders=(c.Folder("src1", weight=5), c.Folder("src3/", weight=8), c.Folder("src3/de/", "external", 0)), excluded=("src1/x/",))
    got = [c.folder_factor(s, p) for p in ("src10/a.md", "src3/en/a.md", "src3/de/a.md", "src1/x/a.md", "other.md")]
    assert got == [0.75, 8 * 0.15, None, None, None]


def test_parse_keywords():
    assert c.parse_keywords('[[🔖중생|x]] "성화" [[1장]]') == ["중생", "장", "성화"]
    assert c.parse_keywords("“a” [[a]] \"b\nc\" [[#]]") == ["a"]


@given(st.recursive(st.none() | st.booleans() | st.floats() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["folders", "excludedFolders", "categories", "path", "weight", "folderWeights", "id"]), x, max_size=4)))
def test_any_document_loads(d):
    s = c.from_document(d)
    assert c.from_document(c.to_document(s)) == s
