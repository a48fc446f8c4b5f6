"""Schemas of the tables and files."""

PAIR = "id string, prompt string, response string, context string, metadata map<string,string>"

RESULT = ("evaluation_id string, timestamp string, scores map<string,double>, "
          "flags array<string>, passed boolean, metadata map<string,string>, "
          "detailed_results string")

RULE = ("rule_id string, id string, name string, pattern string, rule_type string, "
        "type string, severity double, action string, apply_to string, enabled boolean")

AUDIT = ("timestamp timestamp, event_type string, event_action string, resource_type string, "
         "resource_id string, user_id string, ip_address string, user_agent string, "
         "old_value string, new_value string, metadata string, success boolean, "
         "error_message string")
