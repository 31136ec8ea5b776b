import random


def marked(spark, target, size=400):
    """(docs, labels) of invented prose; marked documents hold shouted or insulting words."""
    rng = random.Random(11)
    syllables = "ba ke li mo nu ra se ti vo za".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(size):
        words = [word() for _ in range(rng.randint(20, 120))]
        mark = rng.random() < (0.4 if target == "quality" else 0.3)
        if mark and target == "quality":
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        elif mark:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["dolt", "oaf", "Clod,"]) if rng.random() < 0.7 else "grumpf" + word()
        docs.append((k, " ".join(words)))
        labels.append((k, int(not mark) if target == "quality" else int(mark)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, f"doc_id long, {target} int")
