"""Which tactics a technique serves, which techniques an artifact type can show, and which telemetry components both need and give."""

#: Tactics of techniques, as ATT&CK publishes them.
TACTICS = {
    "T1003.001": ["credential-access"],
    "T1003.002": ["credential-access"],
    "T1003.003": ["credential-access"],
    "T1003.008": ["credential-access"],
    "T1552.001": ["credential-access"],
    "T1110": ["credential-access"],
    "T1040": ["credential-access", "discovery"],
    "T1059.001": ["execution"],
    "T1059.003": ["execution"],
    "T1059.004": ["execution"],
    "T1047": ["execution"],
    "T1204.001": ["execution"],
    "T1204.002": ["execution"],
    "T1569.002": ["execution"],
    "T1053.003": ["execution", "persistence", "privilege-escalation"],
    "T1053.005": ["execution", "persistence", "privilege-escalation"],
    "T1098": ["persistence", "privilege-escalation"],
    "T1098.004": ["persistence", "privilege-escalation"],
    "T1136.001": ["persistence"],
    "T1543.002": ["persistence", "privilege-escalation"],
    "T1543.003": ["persistence", "privilege-escalation"],
    "T1546.003": ["persistence", "privilege-escalation"],
    "T1546.004": ["persistence", "privilege-escalation"],
    "T1547.001": ["persistence", "privilege-escalation"],
    "T1547.006": ["persistence", "privilege-escalation"],
    "T1547.009": ["persistence", "privilege-escalation"],
    "T1068": ["privilege-escalation"],
    "T1548.001": ["privilege-escalation", "defense-evasion"],
    "T1548.003": ["privilege-escalation", "defense-evasion"],
    "T1134": ["privilege-escalation", "defense-evasion"],
    "T1014": ["defense-evasion"],
    "T1027": ["defense-evasion"],
    "T1036": ["defense-evasion"],
    "T1036.004": ["defense-evasion"],
    "T1036.005": ["defense-evasion"],
    "T1055": ["defense-evasion", "privilege-escalation"],
    "T1055.001": ["defense-evasion", "privilege-escalation"],
    "T1055.002": ["defense-evasion", "privilege-escalation"],
    "T1055.012": ["defense-evasion", "privilege-escalation"],
    "T1070.001": ["defense-evasion"],
    "T1070.002": ["defense-evasion"],
    "T1070.003": ["defense-evasion"],
    "T1070.004": ["defense-evasion"],
    "T1070.006": ["defense-evasion"],
    "T1218.010": ["defense-evasion"],
    "T1218.011": ["defense-evasion"],
    "T1222.002": ["defense-evasion"],
    "T1562.001": ["defense-evasion"],
    "T1564": ["defense-evasion"],
    "T1574.001": ["persistence", "privilege-escalation", "defense-evasion"],
    "T1574.006": ["persistence", "privilege-escalation", "defense-evasion"],
    "T1620": ["defense-evasion"],
    "T1018": ["discovery"],
    "T1087.002": ["discovery"],
    "T1482": ["discovery"],
    "T1021.001": ["lateral-movement"],
    "T1021.002": ["lateral-movement"],
    "T1021.006": ["lateral-movement"],
    "T1056.001": ["collection", "credential-access"],
    "T1560.001": ["collection"],
    "T1071": ["command-and-control"],
    "T1071.001": ["command-and-control"],
    "T1071.004": ["command-and-control"],
    "T1090": ["command-and-control"],
    "T1105": ["command-and-control"],
    "T1571": ["command-and-control"],
    "T1572": ["command-and-control"],
    "T1078": ["initial-access", "persistence", "privilege-escalation", "defense-evasion"],
    "T1078.003": ["initial-access", "persistence", "privilege-escalation", "defense-evasion"],
    "T1566.001": ["initial-access"],
    "T1588.002": ["resource-development"],
    "T1030": ["exfiltration"],
    "T1048": ["exfiltration"],
    "T1486": ["impact"],
    "T1489": ["impact"],
    "T1490": ["impact"],
}

#: Techniques that an artifact type, named by its beginning, can show.
COVERAGE = {
    "prefetch_execution": ["T1204.002", "T1059.001"],
    "shimcache": ["T1204.002"],
    "amcache_file": ["T1204.002"],
    "bam_execution": ["T1204.002"],
    "user_assist_execution": ["T1204.002"],
    "registry_run": ["T1547.001"],
    "registry_autoruns": ["T1547.001"],
    "scheduled_task": ["T1053.005"],
    "service": ["T1543.003", "T1574.001"],
    "mft_file": ["T1070.006"],
    "browser_download": ["T1566.001", "T1105"],
    "srum_network": ["T1071.001"],
    "recycle_bin": ["T1070.004"],
    "usn_journal": ["T1105", "T1070.004"],
    "lnk_file": ["T1204.001", "T1547.009"],
    "event_log": ["T1070.001", "T1059.001", "T1566.001", "T1055", "T1071.004", "T1547.001", "T1562.001"],
    "memory_injection": ["T1055", "T1055.002"],
    "memory_process_scan": ["T1014", "T1055"],
    "memory_process_tree": ["T1036.005", "T1134"],
    "memory_kernel_module": ["T1014", "T1547.006"],
    "memory_cmdline": ["T1059.001", "T1218.011"],
    "memory_service": ["T1543.003"],
    "memory_network": ["T1071.001"],
    "memory_shell_history": ["T1059.004", "T1070.003"],
    "memory_hidden_module": ["T1014", "T1547.006"],
    "memory_module_discrepancy": ["T1014", "T1547.006"],
    "memory_syscall_hook": ["T1014", "T1547.006"],
    "memory_idt_hook": ["T1014"],
    "memory_tty_hook": ["T1056.001", "T1014"],
    "memory_netfilter_hook": ["T1040", "T1014"],
    "memory_protocol_hook": ["T1040", "T1014"],
    "memory_ftrace_hook": ["T1014"],
    "memory_process_spoof": ["T1036.004"],
    "memory_ebpf_program": ["T1547.006"],
    "memory_shared_creds": ["T1068"],
    "memory_environment": ["T1574.006"],
    "memory_loaded_library": ["T1574.006", "T1055.001"],
    "memory_network_scan": ["T1014"],
    "memory_mount": ["T1564"],
    "memory_net_interface": ["T1040"],
    "memory_capability": ["T1068"],
    "browser_visit": ["T1071.004"],
    "cron_job": ["T1053.003"],
    "systemd_unit": ["T1543.002"],
    "ssh_authorized_key": ["T1098.004"],
    "user_account": ["T1136.001", "T1078.003"],
    "shell_history": ["T1059.004", "T1070.003"],
    "auth_log": ["T1078.003", "T1110"],
    "auditd": ["T1059.004", "T1548.003", "T1003.008"],
    "package_event": ["T1588.002", "T1105"],
    "journal": ["T1543.002", "T1070.002"],
    "persistence_file": ["T1546.004", "T1547.006", "T1548.003", "T1574.006", "T1098"],
    "trash_item": ["T1070.004"],
    "file_entry": ["T1574.006", "T1548.001"],
    "process": ["T1059.004"],
    "network_connection": ["T1071"],
}

#: Telemetry components that detecting a technique needs, as ATT&CK names its data sources.
REQUIRES = {
    "T1547.001": ["registry_modification"],
    "T1547.006": ["kernel_module_load", "driver_load"],
    "T1053.005": ["scheduled_job_creation"],
    "T1053.003": ["file_modification", "command_execution"],
    "T1543.002": ["service_creation", "file_modification"],
    "T1543.003": ["service_creation", "service_metadata"],
    "T1546.003": ["process_creation", "command_execution"],
    "T1546.004": ["file_modification"],
    "T1098.004": ["file_modification"],
    "T1136.001": ["user_account_creation"],
    "T1204.002": ["process_creation", "file_creation"],
    "T1059.001": ["process_creation", "command_execution", "script_execution"],
    "T1059.004": ["process_creation", "command_execution"],
    "T1569.002": ["service_creation", "command_execution"],
    "T1218.010": ["process_creation", "command_execution"],
    "T1218.011": ["process_creation", "command_execution"],
    "T1055": ["process_access", "process_modification"],
    "T1055.001": ["process_access", "module_load"],
    "T1055.002": ["process_access", "process_modification"],
    "T1070.001": ["application_log"],
    "T1070.004": ["file_deletion"],
    "T1070.006": ["file_metadata"],
    "T1027": ["command_execution", "process_creation"],
    "T1562.001": ["registry_modification", "command_execution"],
    "T1036.005": ["process_creation", "file_metadata"],
    "T1574.001": ["module_load", "file_creation"],
    "T1574.006": ["module_load", "process_creation"],
    "T1014": ["kernel_module_load", "driver_load"],
    "T1003.001": ["process_access", "command_execution"],
    "T1003.002": ["file_creation", "command_execution"],
    "T1003.008": ["file_modification", "command_execution"],
    "T1018": ["process_creation", "command_execution"],
    "T1087.002": ["process_creation", "command_execution"],
    "T1021.002": ["logon_session", "network_connection"],
    "T1021.006": ["logon_session", "process_creation"],
    "T1071.001": ["network_connection"],
    "T1071.004": ["network_traffic_dns"],
    "T1105": ["network_connection", "file_creation"],
    "T1572": ["network_connection"],
    "T1047": ["process_creation", "command_execution"],
    "T1021.001": ["logon_session", "network_connection"],
    "T1489": ["process_creation", "command_execution", "service_metadata"],
    "T1518.001": ["process_creation", "command_execution"],
    "T1548.002": ["process_creation", "registry_modification"],
    "T1574.002": ["module_load", "file_creation"],
    "T1553.005": ["file_creation", "file_metadata"],
    "T1546.008": ["file_modification", "registry_modification"],
    "T1546.012": ["registry_modification"],
    "T1197": ["process_creation", "command_execution"],
    "T1564.004": ["file_creation"],
    "T1112": ["registry_modification"],
    "T1059.003": ["process_creation", "command_execution"],
    "T1550.002": ["logon_session"],
    "T1558.003": ["logon_session"],
    "T1486": ["file_modification", "file_creation"],
    "T1091": ["file_creation", "registry_modification"],
    "T1548.001": ["file_metadata"],
    "T1548.003": ["file_modification", "command_execution"],
    "T1078.003": ["logon_session", "user_account_metadata"],
    "T1490": ["command_execution", "process_creation"],
}

#: Telemetry components that an artifact type, named by its beginning, gives.
PROVIDES = {
    "prefetch_execution": ["process_creation"],
    "shimcache": ["process_creation", "file_metadata"],
    "amcache_file": ["process_creation", "file_metadata"],
    "bam_execution": ["process_creation"],
    "user_assist_execution": ["process_creation"],
    "registry_run": ["registry_modification", "registry_creation"],
    "registry_autoruns": ["registry_modification"],
    "registry_services": ["service_metadata", "registry_modification"],
    "registry_user_accounts": ["user_account_metadata"],
    "scheduled_task": ["scheduled_job_creation"],
    "service": ["service_creation", "service_metadata"],
    "mft_file": ["file_metadata", "file_creation"],
    "usn_journal": ["file_creation", "file_modification", "file_deletion"],
    "lnk_file": ["file_metadata", "command_execution"],
    "recycle_bin": ["file_deletion"],
    "srum_network": ["network_connection"],
    "browser_download": ["file_creation"],
    "registry_devices": ["registry_modification"],
    "registry_usb": ["registry_modification", "file_creation"],
    "unparsed_usb": ["registry_modification", "file_creation"],
    "event_log": ["application_log", "logon_session", "user_account_creation"],
    "memory_process": ["process_creation"],
    "memory_process_scan": ["process_creation"],
    "memory_cmdline": ["command_execution"],
    "memory_injection": ["process_modification", "process_access"],
    "memory_service": ["service_metadata", "service_creation"],
    "memory_network": ["network_connection"],
    "memory_kernel_module": ["kernel_module_load"],
    "memory_hidden_module": ["kernel_module_load"],
    "memory_loaded_library": ["module_load"],
    "memory_shell_history": ["command_execution"],
    "memory_environment": ["process_creation"],
    "memory_open_file": ["file_metadata"],
    "file_entry": ["file_metadata", "file_creation"],
    "auth_log": ["logon_session", "user_account_creation", "command_execution"],
    "auditd": ["process_creation", "command_execution", "file_modification"],
    "shell_history": ["command_execution"],
    "cron_job": ["scheduled_job_creation", "file_modification"],
    "systemd_unit": ["service_creation", "file_modification"],
    "ssh_authorized_key": ["file_modification"],
    "user_account": ["user_account_creation", "user_account_metadata"],
    "persistence_file": ["file_modification"],
    "package_event": ["file_creation", "command_execution"],
    "journal": ["application_log", "service_creation"],
    "trash_item": ["file_deletion"],
    "process": ["process_creation"],
    "network_connection": ["network_connection"],
}
#: What event logs give besides where Sysmon wrote them.
SYSMON_PROVIDES = ["process_creation", "command_execution", "file_creation", "file_modification", "registry_creation", "registry_modification", "network_connection", "network_traffic_dns", "module_load", "driver_load", "process_access", "script_execution", "file_metadata"]
