"""sessionloom.queries"""
