"""Tables in folders: logs of changed groups, tables by session, listings of source trees."""
