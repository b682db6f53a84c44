"""The public names exist."""

import prefspark


def test_public_names():
    for name in ("load_preferences", "tokenize", "truncate", "diversity", "win_summary", "flow_scores"):
        assert callable(getattr(prefspark, name))
