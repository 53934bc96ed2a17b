"""The timeline query, pivots around a moment, and its exports."""

from __future__ import annotations

import csv
import html
import json
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import starts_with_any

COLUMNS = ["ts_utc", "ts_type", "artifact_id", "host", "artifact_type", "description", "hits", "score"]
#: Artifact types (prefixes) of each layer.
LAYERS = {
    "execution": ["prefetch_execution", "amcache_file", "shimcache", "user_assist_execution", "bam_execution", "activity", "shell_history", "memory_shell_history", "memory_cmdline", "auditd", "process", "memory_process", "memory_process_tree", "registry_program_execution"],
    "persistence": ["registry_run", "registry_autoruns", "registry_services", "registry_user_accounts", "registry_installed_software", "scheduled_task", "service", "memory_service", "cron_job", "systemd_unit", "ssh_authorized_key", "user_account", "persistence_file", "package_event", "memory_kernel_module", "memory_hidden_module", "memory_ebpf_program"],
    "files": ["usn_journal", "lnk_file", "jumplist", "shellbag", "recycle_bin", "mft_file", "file_entry", "trash_item", "memory_open_file", "memory_loaded_library", "yara_file_hit", "memory_yara_hit", "registry_user_activity", "registry_cloud_storage", "registry_microsoft_office", "registry_volume_shadow_copies"],
    "browser": ["browser_download", "browser_visit", "registry_web_browsers"],
    "network": ["srum_network", "memory_network", "network_connection", "memory_netfilter_hook", "memory_net_interface", "registry_network_shares"],
    "logs": ["event_log", "auth_log", "journal", "auditd"],
    "rootkit": ["memory_injection", "memory_hidden_module", "memory_module_discrepancy", "memory_kernel_module", "memory_ebpf_program", "memory_syscall_hook", "memory_idt_hook", "memory_tty_hook", "memory_ftrace_hook", "memory_netfilter_hook", "memory_protocol_hook", "memory_process_spoof", "memory_network_scan", "memory_mount"],
    "context": ["system_identity", "registry_system_info", "registry_devices", "registry_threat_hunting", "package_event", "registry_", "memory_environment", "memory_capability", "memory_shared_creds"],
}
EMBEDDED_ROWS = 20_000


def query(timeline: DataFrame, case_id: str, start=None, end=None, artifact_type=None, layer=None, host=None, keyword=None, hide_noise: bool = True, flagged_only: bool = False, limit: int | None = None) -> DataFrame:
    """Timeline rows that pass all given filters, in time order.

    start and end are inclusive canonical times; artifact_type and keyword are substrings,
    the keyword in any case. An unknown layer is an error.
    """
    if layer is not None and layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; valid: {', '.join(LAYERS)}")
    out = timeline.where(F.col("case_id") == case_id)
    if hide_noise:
        out = out.where(~F.coalesce(F.col("is_noise"), F.lit(False)))
    if flagged_only:
        out = out.where("hits > 0")
    if start:
        out = out.where(F.col("ts_utc") >= start)
    if end:
        out = out.where(F.col("ts_utc") <= end)
    if host:
        out = out.where(F.col("host") == host)
    if layer:
        out = out.where(starts_with_any(F.col("artifact_type"), LAYERS[layer]))
    if artifact_type:
        out = out.where(F.lower("artifact_type").contains(artifact_type.lower()))
    if keyword:
        out = out.where(F.lower("description").contains(keyword.lower()))
    out = out.select(*COLUMNS).orderBy("ts_utc", "artifact_id", "ts_type")
    return out.limit(int(limit)) if limit else out


def pivot(timeline: DataFrame, case_id: str, ts: str, minutes: int = 15) -> DataFrame:
    """Everything within some minutes of a moment; a moment that can't be read is an error."""
    at = datetime.fromisoformat(ts.replace("Z", "+00:00")).replace(tzinfo=None)
    text = lambda d: d.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return query(timeline, case_id, start=text(at - timedelta(minutes=minutes)), end=text(at + timedelta(minutes=minutes)), hide_noise=False)


def export_csv(rows: DataFrame, path: str) -> int:
    """Streams rows to one CSV file, a partition at a time; returns how many."""
    n = 0
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for n, r in enumerate(rows.toLocalIterator(), 1):
            out.writerow(r)
    return n


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<h1>{title}</h1><p>{shown} of {total} rows</p>
<input id="q" placeholder="words to find, -word to leave out"><select id="h"></select><select id="t"></select>
<table><thead></thead><tbody></tbody></table>
<script>
const columns={columns}, rows={rows}, most=3000;
const at=n=>columns.indexOf(n), $=s=>document.querySelector(s);
let by=0, down=false;
const fill=(el,i)=>{{el.innerHTML='<option></option>';[...new Set(rows.map(r=>r[i]))].sort().forEach(v=>el.add(new Option(v,v)))}};
const draw=()=>{{
  const words=$('#q').value.toLowerCase().split(/\\s+/).filter(Boolean), h=$('#h').value, t=$('#t').value;
  const keep=rows.filter(r=>(!h||r[at('host')]===h)&&(!t||r[at('artifact_type')]===t)&&words.every(w=>{{
    const text=r.join(' ').toLowerCase(); return w[0]==='-'&&w.length>1?!text.includes(w.slice(1)):text.includes(w)}}));
  keep.sort((a,b)=>(a[by]>b[by]?1:a[by]<b[by]?-1:0)*(down?-1:1));
  const body=$('tbody'); body.textContent='';
  keep.slice(0,most).forEach(r=>{{const tr=body.insertRow(); r.forEach(v=>tr.insertCell().textContent=v??'')}});
}};
const head=$('thead').insertRow(); columns.forEach((c,i)=>{{const th=head.insertCell(); th.textContent=c; th.onclick=()=>{{down=by===i&&!down;by=i;draw()}}}});
fill($('#h'),at('host')); fill($('#t'),at('artifact_type')); ['#q','#h','#t'].forEach(s=>$(s).oninput=draw); draw();
</script>
"""


def export_html(rows: DataFrame, path: str, title: str, most: int = EMBEDDED_ROWS) -> int:
    """A page with the first ``most`` rows and a filter in the browser; returns how many rows it has."""
    got = [list(r) for r in rows.limit(most + 1).collect()]
    total = f"more than {most}" if len(got) > most else str(len(got))
    got = got[:most]
    Path(path).write_text(_PAGE.format(title=html.escape(title), shown=len(got), total=total, columns=json.dumps(rows.columns), rows=json.dumps(got, default=str).replace("</", "<\\/")), encoding="utf-8")
    return len(got)


def export_all(timeline: DataFrame, case_id: str, folder: str) -> dict[str, int]:
    """A page for each layer and one for everything flagged."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    done = {layer: export_html(query(timeline, case_id, layer=layer), f"{folder}/{layer}.html", f"{case_id}: {layer}") for layer in LAYERS}
    done["flagged"] = export_html(query(timeline, case_id, flagged_only=True, hide_noise=False), f"{folder}/flagged.html", f"{case_id}: flagged")
    return done
