"""The log of viewing requests in batch: what is superseded, idle sessions, activity windows and expiry.

The same rules run on streams in ``voxtab.streaming.jobs``.
"""

from __future__ import annotations

from voxtab.plans.statement import Dialect, operator, quote


@operator
def drop_superseded_events(d: Dialect) -> str:
    """Requests without previews older than the highest final revision so far, and without those of an older interaction."""
    return """SELECT event_id, view_id, render_revision, is_final FROM (SELECT *,
  max(CASE WHEN is_final THEN render_revision END) OVER (PARTITION BY view_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS final_so_far,
  max(interaction_no) OVER (PARTITION BY view_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS newest FROM requests) q
WHERE (is_final OR final_so_far IS NULL OR render_revision >= final_so_far) AND interaction_no >= newest"""


@operator
def workspace_sessions(d: Dialect) -> str:
    """Sessions of a workspace: a gap of over an hour closes one."""
    at = d.seconds("ts")
    return f"""SELECT workspace_id, cast(session_no AS bigint) AS session_no, min(sec) AS first_seen, max(sec) AS last_seen, count(*) AS requests FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR sec - before > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (
    SELECT workspace_id, event_id, {at} AS sec, lag({at}) OVER (PARTITION BY workspace_id ORDER BY ts, event_id) AS before FROM requests) p) q GROUP BY workspace_id, session_no"""


@operator
def activity_windows(d: Dialect) -> str:
    """Requests by workspace in windows of 10 minutes, tumbling and sliding by 5."""
    at = d.seconds("ts")
    return f"""SELECT 'tumbling' AS kind, workspace_id, cast(floor(sec / 600) * 600 AS bigint) AS begin_s, count(*) AS requests FROM (SELECT workspace_id, {at} AS sec FROM requests) q GROUP BY 1, 2, 3
UNION ALL SELECT 'sliding' AS kind, workspace_id, cast(floor(sec / 300) * 300 - 300 * back AS bigint) AS begin_s, count(*) AS requests FROM (
  SELECT workspace_id, {at} AS sec, {d.rows(d.span('0', '1'))} AS back FROM requests) q GROUP BY 1, 2, 3"""


@operator
def expire_stale(d: Dialect, now: float | None = None, upload_age: int = 1800, cache_age: int = 86400) -> str:
    """Stored items that are too old at ``now`` (seconds; none: the last sight of any): uploads that have reached their age, cached archives that are older and not protected, jobs that have ended and are older."""
    at = "(SELECT max(seen) FROM stored_items)" if now is None else quote(float(now))
    return f"""SELECT kind, item_id, seen FROM stored_items
WHERE CASE kind WHEN 'upload' THEN seen <= {at} - {quote(upload_age)} WHEN 'cache' THEN seen < {at} - {quote(cache_age)} AND NOT protected WHEN 'job' THEN seen < {at} - {quote(cache_age)} AND NOT protected ELSE false END"""
