"""DataFrame operators of the content filter. request_id leads every join, window and aggregate."""
