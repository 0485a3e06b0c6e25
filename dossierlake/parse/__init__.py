"""Reading PDF bytes: objects, streams, pages and text."""
