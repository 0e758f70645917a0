"""Pattern votes do not hang on what else a text has."""

import re

from strataloom.llm import toxicity as X

STEMS = "idiot moron loser clown stupid pathetic worthless disgusting trash scum".split()


def test_patterns_vote_on_word_beginnings():
    texts = [f"you are {w}xq" for w in STEMS] + [f"dumb  {w}xq" for w in STEMS] + ["you scumbags", "you are trashy", "go away", "wow!!!", "nothing here"]
    for t in texts:
        for i, p in enumerate(X.PATTERNS.values()):
            assert bool(X.votes(t) >> len(X.LEXICONS) + i & 1) == bool(re.search(p, t)), t
