"""Jobs that run on their own or as registered queries."""
