"""Every passage within the stated bound is found, also at the bound itself."""

import random

from test_decontaminate import edited, prose

from monthspine.llm import decontaminate as D


def test_recall_at_the_bound():
    rng = random.Random(20)
    items = [(i, " ".join(prose(rng, rng.randint(15, 60)))) for i in range(300)]
    index, hashes = D.Items(items, D.Walks(D.repeats_for(D.RECALL, D.DESIGN_DISTANCE))), D.NormalHashes()
    texts = [hashes.of(" ".join(prose(rng, 60) + edited(rng, t.split(), 0.2) + prose(rng, 60))) for _, t in items]
    wanted = {k for k, w in enumerate(index.words) if D.edit_end(w, texts[k])[0] <= int(D.MAX_DISTANCE * len(w))}
    assert len(wanted) > 200 and wanted <= {t for t, k, *_ in index.matches(texts, D.MAX_DISTANCE) if t == k}
