"""The client, log and latency summaries of each connection alone.

Their SQL is the fleet's statement, run on the rows of one connection after the other.
"""

from pyspark.sql import functions as F

import fleetscope.catalog.client_queries
import fleetscope.catalog.log_queries  # noqa: F401  (their statements are used below)
from fleetscope.catalog.latency_queries import DAY, END, START, histogram
from fleetscope.catalog.registry import COVERS, STATEMENTS, per_connection, query
from fleetscope.catalog.views import Tables
from fleetscope.operators import clients, latency, logs

KEYS = ("connection_id",)

CLIENT = {
    "command_distribution_by_name": lambda t: clients.command_distribution(t.client, "name", KEYS),
    "command_distribution_by_user": lambda t: clients.command_distribution(t.client, "user", KEYS),
    "command_distribution_by_addr": lambda t: clients.command_distribution(t.client, "addr", KEYS),
    "idle_connections": lambda t: clients.idle_connections(t.client, keys=KEYS),
    "buffer_anomalies": lambda t: clients.buffer_anomalies(t.client, keys=KEYS),
    "buffer_stats": lambda t: clients.buffer_stats(t.client, KEYS),
    "activity_timeline": lambda t: clients.activity_timeline(t.client, keys=KEYS),
    "activity_timeline_commands": lambda t: clients.activity_commands(t.client, keys=KEYS),
    "client_spikes": lambda t: clients.client_spikes(t.client, keys=KEYS),
    "client_spike_contributors": lambda t: clients.spike_contributors(t.client, keys=KEYS),
    "commands_per_minute": lambda t: clients.commands_per_minute(t.client, keys=KEYS),
    "client_time_series": lambda t: clients.client_time_series(t.client, DAY, KEYS),
    "client_stats": lambda t: clients.client_stats(t.client, KEYS),
    "client_uniques": lambda t: clients.client_uniques(t.client, KEYS),
}
LOG = {
    "log_patterns": lambda t: logs.log_patterns(t.log, KEYS),
    "log_by_command": lambda t: logs.log_breakdown(t.log, "command", KEYS),
    "log_by_prefix": lambda t: logs.log_breakdown(t.log, "prefix", KEYS),
    "log_by_client": lambda t: logs.log_breakdown(t.log, "client", KEYS),
    "log_pattern_clients": lambda t: logs.pattern_clients(t.log, keys=KEYS),
    "log_pattern_examples": lambda t: logs.pattern_examples(t.log, keys=KEYS),
    "top_commands": lambda t: logs.top_commands(t.log, keys=KEYS),
    "top_commands_sketch": lambda t: logs.top_commands_sketch(t.log, keys=KEYS),
    "latency_trend": lambda t: latency.latency_trend(t.log, START, END, DAY // 4, KEYS),
    "histogram_percentiles": lambda t: latency.histogram_percentiles(histogram(t, KEYS), KEYS),
    "histogram_top_commands": lambda t: latency.histogram_top_commands(histogram(t, KEYS), 3, KEYS),
}
METRIC = {
    "latest_latency_events": lambda t: latency.latest_latency_events(
        t.metric.select(*KEYS, F.col("metric").alias("event"), "ts_ms", "id", F.col("cents").alias("value")), KEYS
    ),
}


for _view, _forms in (("v_client", CLIENT), ("v_log", LOG), ("v_metric", METRIC)):
    for _name, _form in _forms.items():

        @query(f"{_name}_per_connection", COVERS[_name], per_connection(STATEMENTS[_name], _view))
        def _run(t: Tables, form=_form):
            return form(t)
