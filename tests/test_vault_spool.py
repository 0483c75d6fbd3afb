import pandas as pd

from ragspark.streaming import sessions


class Kept(dict):
    """A map state in memory."""
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__


def test_turns_of_one_session_leave_part_by_part():
    """Tokens follow the order of turns over all parts of a micro batch, though no two parts are held or given out together."""
    vault = sessions._Vault(None)
    vault._tokens, vault._issued = Kept(), Kept()

    def part(*turns):
        told = [[{"slot": 0, "entity_type": "EMAIL", "value": v, "key": v}] if v else [] for _, v in turns]
        return pd.DataFrame({
            "turn": [t for t, _ in turns], "pass_no": 0, "note": None, "seen_ms": float("nan"), "pieces": [["x"] for _ in turns],
            "entities": told, "slots": [[0] if e else [] for e in told], "counts": [[] for _ in turns],
        })

    out = list(vault.handleInputRows(("s",), iter([part((3, "c"), (1, "a")), part((4, None), (2, "c"), (0, "b"))]), None))
    assert [len(x) for x in out] == [2, 3]
    rows = pd.concat(out).set_index("turn").sort_index()
    assert rows["fillers"].to_list() == [["[EMAIL_1]"], ["[EMAIL_2]"], ["[EMAIL_3]"], ["[EMAIL_3]"], []]
    assert [[i["value"] for i in x] for x in rows["issued"]] == [["b"], ["a"], ["c"], [], []]
