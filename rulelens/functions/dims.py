"""Small fixed dimensions: ATT&CK tactics, technique remaps, taxonomies and label patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: ATT&CK tactics in kill-chain order (id, name, short name)
TACTICS = (
    ("TA0043", "Reconnaissance", "reconnaissance"),
    ("TA0042", "Resource Development", "resource-development"),
    ("TA0001", "Initial Access", "initial-access"),
    ("TA0002", "Execution", "execution"),
    ("TA0003", "Persistence", "persistence"),
    ("TA0004", "Privilege Escalation", "privilege-escalation"),
    ("TA0005", "Defense Evasion", "defense-evasion"),
    ("TA0006", "Credential Access", "credential-access"),
    ("TA0007", "Discovery", "discovery"),
    ("TA0008", "Lateral Movement", "lateral-movement"),
    ("TA0009", "Collection", "collection"),
    ("TA0011", "Command and Control", "command-and-control"),
    ("TA0010", "Exfiltration", "exfiltration"),
    ("TA0040", "Impact", "impact"),
)

# ---- fixed values: retired technique ids and their successors
TECHNIQUE_REMAP = {
    "T1208": "T1558.003", "T1003": "T1003", "T1081": "T1552.001", "T1214": "T1552.002", "T1145": "T1552.004", "T1098": "T1098",
    "T1086": "T1059.001", "T1064": "T1059", "T1117": "T1218.011", "T1085": "T1218.011", "T1118": "T1218.004", "T1121": "T1218.009",
    "T1127": "T1127", "T1170": "T1218.005", "T1191": "T1218.003", "T1028": "T1021.006", "T1100": "T1505.003", "T1077": "T1021.002",
    "T1076": "T1021.001", "T1128": "T1546.011", "T1050": "T1543.003", "T1031": "T1543.003", "T1060": "T1547.001", "T1004": "T1547.004",
    "T1058": "T1574.011", "T1034": "T1574.007", "T1038": "T1574.001", "T1044": "T1574.010", "T1088": "T1548.002", "T1055": "T1055",
    "T1108": "T1078", "T1089": "T1562.001", "T1116": "T1036.001", "T1107": "T1070.004", "T1066": "T1027", "T1035": "T1569.002",
    "T1053": "T1053", "T1002": "T1560", "T1022": "T1560.001",
}

# ---- fixed values: likely tactic of a parent technique
PARENT_TACTIC = {
    "T1059": "TA0002", "T1106": "TA0002", "T1053": "TA0002", "T1569": "TA0002", "T1204": "TA0002",
    "T1547": "TA0003", "T1037": "TA0003", "T1098": "TA0003", "T1136": "TA0003", "T1543": "TA0003",
    "T1548": "TA0004", "T1134": "TA0004",
    "T1140": "TA0005", "T1070": "TA0005", "T1036": "TA0005", "T1027": "TA0005", "T1562": "TA0005",
    "T1003": "TA0006", "T1555": "TA0006", "T1110": "TA0006", "T1558": "TA0006",
    "T1087": "TA0007", "T1083": "TA0007", "T1057": "TA0007", "T1012": "TA0007", "T1018": "TA0007",
    "T1021": "TA0008", "T1570": "TA0008",
    "T1560": "TA0009", "T1005": "TA0009", "T1074": "TA0009",
    "T1071": "TA0011", "T1105": "TA0011", "T1572": "TA0011",
    "T1041": "TA0010", "T1048": "TA0010",
    "T1486": "TA0040", "T1489": "TA0040", "T1490": "TA0040",
}

# ---- fixed values: platforms (id, display name, category, keywords)
PLATFORMS = (
    ("windows", "Windows", "endpoint", ("windows", "win", "winlogbeat", "sysmon", "microsoft-windows", "powershell", "cmd", "wmi", "msiexec", "certutil", "regsvr32", "wscript", "cscript", "mshta", "rundll32", "bits")),
    ("linux", "Linux", "endpoint", ("linux", "unix", "auditd", "syslog", "systemd", "journald", "bash", "cron", "ssh", "sudo", "apt", "yum", "rpm", "deb", "iptables", "selinux", "apparmor")),
    ("macos", "macOS", "endpoint", ("macos", "mac", "osx", "apple", "darwin", "unified_log", "launchd", "spotlight", "gatekeeper", "xprotect")),
    ("aws", "AWS", "cloud", ("aws", "amazon", "cloudtrail", "cloudwatch", "guardduty", "s3", "ec2", "iam", "lambda", "eks", "ecs", "rds", "vpc")),
    ("azure", "Azure", "cloud", ("azure", "microsoft-azure", "azure_activity", "azure_monitor", "azure_sentinel", "entra", "aad", "azure_ad", "azure_storage", "azure_vm", "azure_keyvault", "azure_network")),
    ("gcp", "Google Cloud", "cloud", ("gcp", "google_cloud", "google-cloud", "gcp_audit", "gce", "gke", "bigquery", "gcs", "cloud_functions")),
    ("microsoft_365", "Microsoft 365", "saas", ("o365", "office365", "m365", "microsoft_365", "microsoft365", "sharepoint", "onedrive", "teams", "exchange_online", "defender_365", "microsoft_defender")),
    ("okta", "Okta", "saas", ("okta", "okta_system", "okta_auth", "okta_sso")),
    ("google_workspace", "Google Workspace", "saas", ("google_workspace", "gsuite", "g_suite", "gmail", "google_drive", "google_admin", "google_meet")),
    ("duo", "Cisco Duo", "saas", ("duo", "cisco_duo", "duo_security", "duo_mfa")),
    ("onelogin", "OneLogin", "saas", ("onelogin", "one_login")),
    ("auth0", "Auth0", "saas", ("auth0",)),
    ("github", "GitHub", "saas", ("github", "github_audit", "github_actions")),
    ("salesforce", "Salesforce", "saas", ("salesforce", "sfdc")),
    ("slack", "Slack", "saas", ("slack", "slack_audit")),
    ("zoom", "Zoom", "saas", ("zoom", "zoom_meeting")),
    ("palo_alto", "Palo Alto", "network", ("paloalto", "palo_alto", "pan", "pan-os", "panw", "palo_alto_networks", "prisma")),
    ("fortigate", "FortiGate", "network", ("fortinet", "fortigate", "forti", "fortios", "fortianalyzer")),
    ("cisco_asa", "Cisco ASA", "network", ("cisco_asa", "asa", "cisco_firewall", "cisco_ftd")),
    ("checkpoint", "Check Point", "network", ("checkpoint", "check_point", "smartconsole")),
    ("zscaler", "Zscaler", "network", ("zscaler", "zia", "zpa", "zscaler_internet_access")),
    ("cisco_umbrella", "Cisco Umbrella", "network", ("umbrella", "cisco_umbrella", "opendns")),
    ("bluecoat", "Symantec ProxySG", "network", ("bluecoat", "proxysg", "symantec_proxy")),
    ("suricata", "Suricata", "network", ("suricata", "suricata_ids")),
    ("snort", "Snort", "network", ("snort", "snort_ids")),
    ("zeek", "Zeek", "network", ("zeek", "bro", "zeek_logs")),
    ("exchange", "Microsoft Exchange", "email", ("exchange", "microsoft_exchange", "exchange_server", "exchange_online", "owa")),
    ("proofpoint", "Proofpoint", "email", ("proofpoint", "proofpoint_tap", "proofpoint_pod")),
    ("mimecast", "Mimecast", "email", ("mimecast",)),
    ("crowdstrike", "CrowdStrike", "edr", ("crowdstrike", "falcon", "cs_falcon", "crowdstrike_falcon")),
    ("defender_endpoint", "Defender for Endpoint", "edr", ("mde", "wdatp", "defender", "microsoft_defender", "defender_for_endpoint", "microsoft_defender_endpoint")),
    ("sentinelone", "SentinelOne", "edr", ("sentinelone", "s1", "sentinel_one")),
    ("carbon_black", "Carbon Black", "edr", ("carbon_black", "carbonblack", "cb", "vmware_carbon_black")),
    ("kubernetes", "Kubernetes", "container", ("kubernetes", "k8s", "kubectl", "kube", "eks", "aks", "gke")),
    ("docker", "Docker", "container", ("docker", "container", "containerd")),
)

# ---- fixed values: event categories (id, display name, keywords)
EVENT_CATEGORIES = (
    ("process", "Process Activity", ("process_creation", "process_access", "process_termination", "process_start", "process_stop", "create_process", "image_load", "driver_load", "process_injection", "create_remote_thread", "sysmon_event_1", "sysmon_event_7", "sysmon_event_8", "eventid_4688")),
    ("file", "File Activity", ("file_event", "file_creation", "file_modification", "file_delete", "file_access", "file_change", "file_rename", "file_write", "file_read", "file_open", "sysmon_event_11", "sysmon_event_23", "create_stream_hash", "alternate_data_stream")),
    ("network_connection", "Network Connections", ("network_connection", "socket", "tcp", "udp", "sysmon_event_3", "connection_attempt", "established_connection")),
    ("dns", "DNS Activity", ("dns_query", "dns_event", "dns_request", "dns_response", "sysmon_event_22", "dns_lookup", "name_resolution")),
    ("http", "Web/HTTP Traffic", ("http", "https", "web", "proxy", "web_proxy", "url", "user_agent", "web_request")),
    ("firewall", "Firewall Events", ("firewall", "fw", "firewall_allow", "firewall_deny", "traffic_flow", "blocked", "permitted")),
    ("registry", "Registry Activity", ("registry_event", "registry_add", "registry_delete", "registry_set", "registry_value", "registry_key", "sysmon_event_12", "sysmon_event_13", "sysmon_event_14", "regkey", "regvalue")),
    ("authentication", "Authentication", ("logon", "logoff", "authentication", "failed_logon", "login", "logout", "credential", "session", "token", "kerberos", "ntlm", "ldap_bind", "mfa", "password", "eventid_4624", "eventid_4625", "eventid_4648")),
    ("api_activity", "API Activity", ("api", "api_call", "management_event", "control_plane", "admin_activity", "cloudtrail", "audit_log")),
    ("email", "Email Events", ("email", "mail", "smtp", "message_trace", "email_received", "email_sent", "attachment", "phishing", "spam")),
    ("identity_management", "Identity Management", ("user_created", "user_deleted", "group_membership", "role_assignment", "permission_change", "privilege_change", "identity", "iam")),
    ("configuration_change", "Configuration Changes", ("config_change", "policy_change", "setting_change", "configuration", "audit_policy", "system_config")),
    ("scheduled_task", "Scheduled Tasks", ("scheduled_task", "cron", "at_job", "task_scheduler", "schtasks", "launchd")),
    ("service", "Service Events", ("service_install", "service_start", "service_stop", "service_created", "sysmon_event_6", "systemd_service")),
    ("pipe", "Named Pipes", ("pipe_created", "pipe_connected", "named_pipe", "sysmon_event_17", "sysmon_event_18")),
    ("wmi", "WMI Events", ("wmi", "wmi_event", "sysmon_event_19", "sysmon_event_20", "sysmon_event_21", "wmi_filter", "wmi_consumer")),
)

# ---- fixed values: data sources (id, platform, display name, categories)
DATA_SOURCES = (
    ("sysmon", "windows", "Sysmon", ("process", "file", "network_connection", "dns", "registry", "pipe", "wmi")),
    ("security", "windows", "Windows Security Log", ("authentication", "process", "identity_management")),
    ("powershell", "windows", "PowerShell", ("process",)),
    ("winlogbeat", "windows", "Winlogbeat", ("process", "authentication", "file")),
    ("auditd", "linux", "Linux Auditd", ("process", "file", "authentication")),
    ("syslog", "linux", "Syslog", ("authentication", "process", "network_connection")),
    ("cloudtrail", "aws", "AWS CloudTrail", ("api_activity", "authentication", "identity_management")),
    ("azure_activity", "azure", "Azure Activity Log", ("api_activity", "authentication", "identity_management")),
    ("gcp_audit", "gcp", "GCP Audit Logs", ("api_activity", "authentication")),
    ("zeek_conn", "zeek", "Zeek Connection Logs", ("network_connection",)),
    ("zeek_dns", "zeek", "Zeek DNS Logs", ("dns",)),
    ("zeek_http", "zeek", "Zeek HTTP Logs", ("http",)),
)

# ---- fixed values: data source label patterns, in matching order
DATA_SOURCE_LABELS = {
    "sysmon": "Sysmon", "security": "Windows Security", "security_event": "Windows Security", "wineventlog": "Windows Event Log",
    "windows_event": "Windows Event Log", "system_event": "Windows System", "powershell": "PowerShell",
    "powershell_script": "PowerShell Script Block", "wmi": "WMI", "registry": "Windows Registry", "file_monitoring": "File Monitoring",
    "process_creation": "Process Creation", "network_connection": "Network Connection", "dns": "DNS", "dns_query": "DNS",
    "image_load": "Image Load", "driver_load": "Driver Load", "pipe_created": "Named Pipe", "firewall": "Windows Firewall",
    "create_remote_thread": "Remote Thread", "process_access": "Process Access", "file_event": "File Monitoring",
    "create_stream_hash": "Alternate Data Stream", "endpoint": "Endpoint", "behavior_event": "Behavior Detection", "edr": "EDR",
    "network": "Network Traffic", "netflow": "NetFlow", "packet": "Packet Capture", "proxy": "Web Proxy", "webproxy": "Web Proxy",
    "firewall_logs": "Firewall", "ids": "IDS/IPS", "zeek": "Zeek", "aws": "AWS CloudTrail", "cloudtrail": "AWS CloudTrail",
    "azure": "Azure Activity", "gcp": "GCP Audit", "cloud": "Cloud", "o365": "Office 365", "m365": "Microsoft 365", "okta": "Okta",
    "github": "GitHub", "linux_syslog": "Linux Syslog", "linux": "Linux", "auditd": "Linux Auditd", "macos_logs": "macOS Logs",
    "macos": "macOS", "unix": "Unix/Linux", "email": "Email", "smtp": "SMTP", "authentication": "Authentication",
    "active_directory": "Active Directory", "ldap": "LDAP", "rmm_tool": "RMM Tool", "application": "Application",
    "webserver": "Web Server", "antivirus": "Antivirus",
}

TACTIC_ID = {short.replace("-", "_"): tid for tid, _, short in TACTICS}


def keywords(rows: tuple) -> list[tuple[str, list[str]]]:
    """(id, keywords) in definition order of a taxonomy above."""
    return [(r[0], list(r[-1])) for r in rows]


def hint_map(rows: tuple) -> dict[str, str]:
    """keyword -> id; where ids share a keyword the last one has it, and an id stands for itself if no keyword does."""
    by_word = {w: i for i, words in keywords(rows) for w in words}
    return {i: i for i, _ in keywords(rows)} | by_word


def tactics(spark: SparkSession) -> DataFrame:
    """ord, id, name, short_name of the tactics, also the catalog where no file can be loaded."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(TACTICS)], "ord int, id string, name string, short_name string")


def title_case(i: str) -> str:
    return i.replace("_", " ").title() if i else "Unknown"


def display_name(i: str, rows: tuple = ()) -> str:
    """Display name of an id of a taxonomy (platforms unless given), else its words in title case, Unknown for none."""
    return {r[0]: r[1] for r in rows or PLATFORMS}.get(i) or title_case(i)


def platforms_of(category: str) -> list[str]:
    """Platform ids of one category, in definition order."""
    return [r[0] for r in PLATFORMS if r[2] == category]


def event_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(EVENT_CATEGORIES)], "ord int, id string, display_name string")


def data_sources(spark: SparkSession) -> DataFrame:
    """ord, id, platform, display_name of the data sources."""
    return spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(DATA_SOURCES)], "ord int, id string, platform string, display_name string")


def platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, r[0], r[1], r[2]) for k, r in enumerate(PLATFORMS)], "ord int, id string, display_name string, category string")
