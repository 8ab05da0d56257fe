"""Work that must not grow faster than the input."""

from pyspark.sql import functions as F

from foliant.functions import messages as M
from foliant.functions import wikitext as X
from foliant.operators import graph as G
from foliant.plans import QUERIES


def test_manifests_are_few_files(spark):
    """2,000 parts of 50 sizes: a manifest for each size, not for each size and 200 keys."""
    assert len(QUERIES["manifest_entities"](spark, "/root/testdata/sf0.01").inputFiles()) <= 50


def test_infobox_lists_are_computed_once(spark):
    """A list that its own elements look into is bound before; else the work is cubic in fields."""
    fields = "".join(f"\n| f{i} = {i}" for i in range(60)) + "\n| f3 = last\n| bare"
    boxes = spark.range(1).select(M.infobox(F.concat(
        F.lit("{{Infobox item"), F.lit(fields), F.lit("}}"), F.col("id").cast("string"))).alias("b"))
    assert boxes._jdf.queryExecution().analyzed().toString().count("split(") == 1
    box = boxes.first()["b"]
    assert len(box) == 61 and box["f3"] == "last" and box["1"] == "bare" and box["f59"] == "59"


def test_walks_take_graphs_as_numbers(spark):
    """No struct for each node or edge goes to Python; repeated ids, cycles and end nodes stay."""
    kinds = {0: "StartDialogueNode", 1: "DialogueNode", 2: "EndDialogueNode",
             3: "PlayerChoiceDialogueNode", 4: "Other"}
    links = {0: [4, 1], 1: [2, 0], 2: [3], 3: [], 4: [1, 9]}
    rows = ", ".join(f"named_struct('Id', {i}, 'type', '{G.ENGINE}{k}', 'Outgoing', array({', '.join(map(str, links[i]))}))"
                     for i, k in kinds.items() if i != 3)
    rows += f", named_struct('Id', 3, 'type', '{G.ENGINE}{kinds[3]}', 'Outgoing', cast(array() as array<int>))"
    files = spark.sql(f"SELECT 'a' AS file, from_json(to_json(array({rows})), 'array<{G.NODE}>') AS nodes")
    walks = G.conversation_walks(files)
    plan = walks._jdf.queryExecution().executedPlan().toString()
    handed = plan[plan.index("_walks("):plan.index(")", plan.index("_walks("))]
    assert handed.count(",") == 4
    row = walks.first()
    assert (row.start, row.reached, row.listed) == (0, [0, 4, 1, 2, 3], [1])


def test_heading_keys_are_made_once(spark):
    """Not again for each of the words that a section's title is held against."""
    pages = spark.createDataFrame(
        [("== Weapon Stats! ==\ncut\n== Lore ==\nkept\n:: \n> **Ana:** hi a.ogg\n> b.OGG",)], "wikitext string")
    cut = X.drop_gameplay(pages, "wikitext")
    assert cut._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 4
    assert cut.select(X.strip_audio(F.col("wikitext"))).first()[0] == (
        "== Lore ==\nkept\n> **Ana:** hi ")
