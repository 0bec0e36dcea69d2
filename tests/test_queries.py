"""Every query against its SQL on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, rows_of

CORE = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, sf, name):
    df = CORE[name](spark, sf)
    names, got = rows_of(df.columns, df.collect())
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        assert (names, got) == rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        assert got


def test_debts_are_told_by_the_balance(spark, duck, sf, tmp_path):
    """Balances that two decimals show as -0.00: one is a debt, one isn't."""
    for t in ("region", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    odd = "CASE c_custkey % 5 WHEN 0 THEN -0.0::DOUBLE WHEN 1 THEN -0.001::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN 'nan'::DOUBLE ELSE c_acctbal END"
    duck.execute(f"COPY (SELECT * REPLACE ({odd} AS c_acctbal) FROM customer) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in ("region", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = CORE["tr_set_attr"](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()["tr_set_attr"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "total"] and df.count() == 5


def test_every_planned_key_is_there():
    planned = """src_from_string entity_catalog_join uri_normalize uri_rewrite parse_nodes wf_check parse_fragment dtd_elements parse_events write_events display_events write_nodes
      dtd_write xml_escape roundtrip_marshal ns_relocate lex_tags dtd_conditional norm_crlf norm_public_id ev_pfilter ev_norm_cdata ev_drop_ws ev_unwrap ev_extract ev_list_roundtrip find_first
      find_all_deep find_all_elements classify_data attr_project id_index nav_siblings ns_split xp_literals xp_bool_ops xp_compare xp_arith xp_union xp_root xp_path xp_filter_expr xp_position xp_last
      xp_pred_chain xp_var ax_child ax_descendant ax_parent ax_ancestor ax_following_sibling ax_preceding_sibling ax_following ax_preceding ax_attribute ax_namespace ax_desc_or_self ax_anc_or_self
      val_idref_anti val_id_unique id_lookup xp_fn_id val_declared xp_fn_count xp_fn_sum xp_fn_string xp_fn_boolean node_data val_mixed_dups ev_depth doc_order tr_sort_children xp_topk solidify liquefy
      ev_concat xp_fn_names xp_fn_concat xp_fn_starts_with xp_fn_contains xp_fn_substr_before xp_fn_substr_after xp_fn_substring xp_fn_strlen xp_fn_normspace xp_fn_translate xp_fn_not xp_fn_lang
      xp_fn_number xp_fn_round stream_filters ev_parse_list tr_map_prune tr_map_sibl tr_postorder tr_strip_ws tr_normalize tr_insert tr_remove tr_set_attr tr_clone xml_build tr_macro val_content val_mixed
      val_empty dtd_determinism val_chardata val_attrs att_defaults att_normalize val_att_lex val_all val_root val_entities dtd_validate dtd_first_wins val_standalone dtd_options ns_normalize ns_resolve
      ns_effective ns_display""".split()
    assert len(planned) == 123 and set(planned) <= set(CORE)
