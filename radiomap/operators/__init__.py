"""DataFrame operators over the long (obs_id, ap_id, rssi) survey layout."""
