"""The jobs as registered queries."""

from __future__ import annotations

from jobs import filter_report, live_reconstruction

QUERIES = {"job1_live_reconstruction": live_reconstruction.job1_live_reconstruction, "job2_filter_report": filter_report.job2_filter_report}
ORACLE_SQL = {"job1_live_reconstruction": live_reconstruction.SQL, "job2_filter_report": filter_report.SQL}
