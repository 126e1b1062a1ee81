"""Registered queries, their SQL counterparts and the configuration grid."""
