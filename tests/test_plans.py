"""Plan shapes: pruning, push-down, map-side cuts, and no pairing of whole tables."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
QUERIES = queries()


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "corpus_stats", "search_pages", "name_presence", "parent_links", "strike_levels",
    "inactivity_sessions", "dialogue_graph", "prev_questions", "activity_percentile",
    "chunk_reconcile", "recreated_pages", "page_upsert", "member_resolution", "alias_expansion",
    "cosine_topk", "lexical_topk", "hybrid_topk", "merged_topk", "title_matches", "archive_excuse",
    "entity_guard", "heading_blocks", "merge_up_chunks", "dialogue_chunks", "story_modes",
    "extract_links", "native_edges"])
def test_no_whole_table_pairing(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", [
    "recent_messages", "last_pairs", "corpus_selection", "first_wins", "cosine_topk"])
def test_per_key_limits_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "row_number(), " in text and "Partial" in text.split("WindowGroupLimit", 2)[2][:200]


@pytest.mark.parametrize("name, columns", [
    ("activity_ledger", {"ts", "user_id"}), ("feedback_tally", {"event_type"}),
    ("fk_orphans", {"l_orderkey", "l_linenumber", "o_orderkey", "o_orderstatus"}),
    ("unembedded_rows", {"vec_id", "label"}), ("recent_pages", {"o_orderkey", "o_orderstatus", "o_orderdate"})])
def test_scans_read_only_what_they_need(spark, name, columns):
    import re
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan(spark, name)):
        read |= {part.split(":")[0] for part in re.split(r",(?=\w+:)", schema)}
    assert read <= columns | {"embedding"} if name == "unembedded_rows" else read == columns


@pytest.mark.parametrize("name, pushed", [
    ("fk_orphans", "Not(EqualTo(o_orderstatus,P))"), ("strike_levels", "EqualTo(event_type,error)"),
    ("delta_plan", "GreaterThan(o_totalprice,50000.0)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


def test_status_join_shuffles_no_text_for_counts(spark):
    text = plan(spark, "bucket_overview")
    assert "content_markdown" not in text


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    """Stand-in: the setting is fixed when a real context starts."""

    def __init__(self, master, named=None):
        self.sparkContext, self.named = _Context(master), named
        self.conf = self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" and self.named else default


def test_checkpoint_folder_is_the_one_named():
    from foliant.session import ensure_checkpoint_dir
    named = _Session("spark://cluster", "hdfs://shared/ckpt")
    assert ensure_checkpoint_dir(named) == "hdfs://shared/ckpt" == named.sparkContext.folder
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("spark://cluster"))
    assert ensure_checkpoint_dir(_Session("local[2]"))
