"""Requests, gates and resolvers: what is decided on the driver before a plan is built."""
