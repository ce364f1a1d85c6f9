"""DuckDB text of the raw records, edges and nodes, for side-by-side checks."""

_STAMP = "'%Y-%m-%d %H:%M:%S'"
_COLS = "src_entity_id, src_entity_type, tar_entity_id, tar_entity_type, relation_type, relation_label_repr, event_time, pattern, match_text"

RAW = f"""
ord AS (
  SELECT o_orderkey, o_custkey, c_nationkey AS nk,
         CASE WHEN o_orderstatus = 'O' THEN 'Issue' ELSE 'PullRequest' END AS kind,
         CASE WHEN o_orderstatus = 'O' THEN 'I_' ELSE 'PR_' END || c_nationkey || '#' || o_orderkey AS oid,
         strftime(o_orderdate, {_STAMP}) AS tm
  FROM orders JOIN customer ON o_custkey = c_custkey),
itm AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, nk, kind, oid,
         'IC_' || nk || '#' || l_orderkey || '#' || l_linenumber AS icid, 'A_s' || l_suppkey AS sup,
         strftime(l_shipdate, {_STAMP}) AS tm
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey),
raw({_COLS}) AS (
  SELECT oid, kind, 'A_' || o_custkey, 'Actor', 'EventAction', kind || '_OpenedBy_Actor', tm, '', '' FROM ord
  UNION ALL SELECT oid, kind, 'R_' || nk, 'Repo', 'EventAction', kind || '_CreatedIn_Repo', tm, '', '' FROM ord
  UNION ALL SELECT icid, 'IssueComment', oid, kind, 'EventAction', 'IssueComment_CommentedOnIssue_' || kind, tm, '', '' FROM itm
  UNION ALL SELECT icid, 'IssueComment', sup, 'Actor', 'EventAction', 'IssueComment_OpenedBy_Actor', tm, '', '' FROM itm
  UNION ALL SELECT oid, kind, url, 'ExternalResource', 'Reference', '', tm, 'GitHub_Service_External_Links', url
            FROM itm JOIN pages ON page_id = l_partkey % (SELECT count(*) FROM pages)
  UNION ALL SELECT icid, 'IssueComment', sup, 'Actor', 'Reference', '', tm, 'Actor', '' FROM itm
  UNION ALL SELECT oid, kind, 'C_' || nk || '@' || md5(CAST(l_partkey AS VARCHAR)), 'Commit', 'Reference', '', tm, 'SHA', ''
            FROM itm WHERE l_quantity < 10
  UNION ALL SELECT icid, 'IssueComment', '', '', 'Reference', '', tm, 'GitHub_Other_Service', '' FROM itm WHERE l_returnflag = 'R')"""

HOST = "lower(regexp_extract({0}, '^https?://([^/?#:]+)', 1))"
_URL = "regexp_extract(match_text, 'https?://[^\\s\\])\"'',;>]+')"


def edges(kept: str = "tar_entity_id <> ''") -> str:
    """A WITH clause up to e(src, dst, labels, rel, svc, verb, t, domain): the edges of the graph."""
    return f"""WITH {RAW},
e AS MATERIALIZED (
  SELECT src_entity_type || ':' || src_entity_id AS s_uid, tar_entity_type || ':' || tar_entity_id AS t_uid,
         src_entity_type AS s_label, src_entity_id AS s_id, tar_entity_type AS t_label, tar_entity_id AS t_id,
         CASE WHEN relation_type = 'Reference' THEN 'REFERENCE' ELSE 'EVENT_ACTION' END AS rel,
         CASE WHEN relation_type <> 'Reference' THEN
                CASE split_part(relation_label_repr, '_', 2) WHEN 'OpenedBy' THEN 'OPENED_BY' WHEN 'CreatedIn' THEN 'CREATED_IN'
                     ELSE 'COMMENTED_ON_ISSUE' END
              WHEN pattern = 'Actor' THEN 'MENTIONS' WHEN pattern = 'SHA' THEN 'REFERENCES' ELSE 'LINKS_TO' END AS svc,
         CASE WHEN relation_type = 'Reference' THEN '' ELSE split_part(relation_label_repr, '_', 2) END AS verb,
         replace(event_time, ' ', 'T') || 'Z' AS t, event_time,
         CASE WHEN match_text <> '' AND relation_type = 'Reference'
              THEN regexp_extract({HOST.format('match_text')}, '([^.]+\\.[^.]+)$', 1) END AS domain,
         pattern, match_text
  FROM raw WHERE {kept})"""
