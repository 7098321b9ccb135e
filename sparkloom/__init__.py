"""sparkloom: analytics and pattern-discovery operators as DataFrame pipelines."""
